"""DuckDB twins of the corpus queries that SQL can express."""

ORACLES = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT *, sha1(html) AS hex, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place,
                     max(page_id) OVER (PARTITION BY html) AS keep_id FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN keep_id END AS refers_to
        FROM d""",
    "op8_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        per AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER
                       (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM per),
        targets AS (
            SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS rank,
                   ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 5))::INT / 1048576.0::DOUBLE AS u
            FROM sized),
        joined AS (
            SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
            FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT * size AS taken,
               (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::INT AS copies
        FROM joined""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hash,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
            FROM documents),
        h AS (
            SELECT *, len(tokens) AS n, ('0x' || substr(hash, 1, 8))::BIGINT AS h1, ('0x' || substr(hash, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(hash, 17, 8))::BIGINT AS h3, ('0x' || substr(hash, 25, 8))::BIGINT AS h4 FROM d),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                        THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM h),
        p AS (
            SELECT *, array_to_string(tokens[1:c1], '') AS prefix, array_to_string(tokens[c1 + 1:c2], '') AS middle,
                   array_to_string(tokens[c2 + 1:], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
