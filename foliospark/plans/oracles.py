"""The registered queries in DuckDB SQL, for checking results."""

from __future__ import annotations

from ..functions import budget, metadata
from ..functions.text import SPACE_CHARS
from ..operators import chunk_structure as cst
from .inputs import BROKEN_REWRITES, CODE_REWRITES, CS, MARKDOWN_REWRITES, SAMPLE, WORDS_CS
from .queries import ERROR_TEXTS, GENERATED

NL = "chr(10)"
DOCS = "SELECT doc_id, text FROM documents"
FILES = """SELECT ['', 'a/', '_b/', '.c/d/'][(doc_id % 4 + 1)::INT] || ['', '_', '.'][(doc_id % 3 + 1)::INT] || doc_id
      || CASE WHEN doc_id % 5 = 0 THEN '.log' ELSE '.md' END AS rel_path,
    CASE WHEN doc_id % 10 = 1 THEN 0 ELSE strlen(text) END::BIGINT AS length FROM documents"""


def lit(s: str) -> str:
    """A SQL string literal; newlines are spelled out."""
    parts = [p.replace("'", "''") for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


def replaced(pairs) -> str:
    text = "text"
    for old, new in pairs:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return f"SELECT doc_id, {text} AS text FROM documents"


BROKEN_DOCS = replaced(BROKEN_REWRITES)
CODE_DOCS = replaced(CODE_REWRITES)
MD_DOCS = replaced(MARKDOWN_REWRITES)
ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def lines(src: str) -> str:
    """CTEs src and lines(doc_id, line_no, s): lines with their terminators."""
    return f"""
    src AS ({src}),
    lines AS (
      SELECT doc_id, i - 1 AS line_no, CASE WHEN i < len(p) THEN p[i] || {NL} ELSE p[i] END AS s
      FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM src), unnest(range(1, len(p) + 1)) AS u(i)
      WHERE NOT (i = len(p) AND p[i] = ''))"""


def packed(cs: int = CS) -> str:
    """From lines: pieces, items, walk, chunks(doc_id, chunk_index, text, token_count)."""
    w = 4 * cs - 1
    return f"""
    items AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, j) AS r, s, solo, length(s) // 4 + 1 AS k
      FROM (
        SELECT doc_id, line_no, j, length(s) > {w} AS solo,
               CASE WHEN length(s) > {w} THEN substr(s, j * {w} + 1, {w}) ELSE s END AS s
        FROM lines, unnest(range(0, CASE WHEN length(s) > {w} THEN (length(s) - 1) // {w} + 1 ELSE 1 END)) AS u(j))),
    walk AS (
      SELECT doc_id, r, k AS tk, 0 AS c, solo FROM items WHERE r = 1
      UNION ALL
      SELECT i.doc_id, i.r,
             CASE WHEN i.solo OR w.solo OR w.tk + i.k > {cs} THEN i.k ELSE w.tk + i.k END,
             w.c + CASE WHEN i.solo OR w.solo OR w.tk + i.k > {cs} THEN 1 ELSE 0 END, i.solo
      FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.r = w.r + 1),
    chunks AS (
      SELECT w.doc_id, CAST(w.c AS INTEGER) AS chunk_index, string_agg(i.s, '' ORDER BY i.r) AS text,
             CAST(max(w.tk) AS INTEGER) AS token_count, count(*) AS n_items, bool_or(i.solo) AS solo, min(i.r) AS first_item
      FROM walk w JOIN items i USING (doc_id, r) GROUP BY w.doc_id, w.c)"""


WORD_RUNS = r"regexp_extract_all({0}, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+$')"
N_WORDS = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"


def word_items(cs: int) -> str:
    """items as in packed(), sized in words; a longer line is cut before every ``cs``-th next word."""
    return f"""
    items AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, j) AS r, s, solo, {N_WORDS.format('s')} AS k
      FROM (
        SELECT doc_id, line_no, j, n > {cs} AS solo,
               CASE WHEN n > {cs} THEN array_to_string(w[j * {cs} + 1 : (j + 1) * {cs}], '') ELSE s END AS s
        FROM (SELECT *, {N_WORDS.format('s')} AS n, {WORD_RUNS.format('s')} AS w FROM lines),
             unnest(range(0, CASE WHEN n > {cs} THEN (n - 1) // {cs} + 1 ELSE 1 END)) AS u(j))),"""


def packed_words(cs: int) -> str:
    """packed() by words."""
    return word_items(cs) + packed(cs).split("AS u(j))),", 1)[1]


def chunk_ctes(src: str = DOCS, cs: int = CS) -> str:
    return "WITH RECURSIVE " + lines(src) + "," + packed(cs)


CHUNKS = chunk_ctes()
CHUNK_COLUMNS = "doc_id, chunk_index, text, token_count"
ALL_CHUNKS = f"{CHUNKS} SELECT {CHUNK_COLUMNS} FROM chunks"

PATHS = """SELECT doc_id, n_chars AS length,
  concat_ws('/', source, lang, ['a', 'build', 'c', '.git'][doc_id % 4 + 1],
            doc_id || ['.md', '.log', '.txt'][doc_id % 3 + 1]) AS rel_path FROM documents"""

FRONT = """SELECT doc_id, source, lang, text, doc_id % 3 <> 0 AS whole FROM documents"""
#: The values that every header has besides the required fields.
OTHER_JSON = """',"n":' || doc_id || ',"ratio":2.5,"note":"no","empty":null,"draft":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
  || CASE WHEN doc_id % 4 = 0 THEN ',"tags":["a",7,{"k":"v"}]' ELSE '' END"""
FRONT_JSON = f"""'{{"title":"T' || doc_id || '","author":"' || source || '","type":"' || lang || '"' || {OTHER_JSON}
  || CASE WHEN whole THEN ',"id":"D' || doc_id || '","date":"2024-01-05"' ELSE '' END || '}}'"""
BODY = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"

ELEMENTS = f"SELECT doc_id, i - 1 AS line_no, '<p>' || {ESCAPED.format('p[i]')} || '</p>' AS s FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)"
XML_PACK = f"""WITH RECURSIVE lines AS ({ELEMENTS}), {packed()}
  SELECT doc_id, chunk_index, CASE WHEN n_items > 1 THEN '<x>' || text || '</x>' ELSE text END AS text,
         CAST(CASE WHEN n_items > 1 THEN length(text) + 7 ELSE length(text) END // 4 + 1 AS INTEGER) AS token_count
  FROM chunks"""

ERR = """CASE WHEN (chunk_index + 1) % 7 = 0 THEN 'server error: simulated'
  WHEN (chunk_index + 1) % 11 = 0 THEN 'server error: the model sent no text' END"""


def responses(extra: str = "") -> str:
    """CTE resp over chunks."""
    pick = f", d.{extra}" if extra else ""
    join = " JOIN documents d USING (doc_id)" if extra else ""
    return f"""{CHUNKS}, resp AS (
      SELECT *, CASE WHEN error IS NULL THEN '> ' || text END AS response,
             CASE WHEN error IS NULL THEN (length(text) + 2) // 4 + 1 END AS response_tokens,
             CASE WHEN error IS NULL THEN length(text) + 2 END AS response_chars,
             token_count + 10 AS total_input_tokens,
             CASE WHEN chunk_index % 5 = 0 THEN 'fallback1' ELSE 'primary' END AS model,
             token_count * 0.25::DOUBLE AS seconds
      FROM (SELECT c.doc_id, c.chunk_index, c.text, c.token_count, {ERR} AS error{pick} FROM chunks c{join}))"""


NOTE = "'[ERROR: Chunk ' || (chunk_index + 1) || ' failed - ' || error || ']'"
STATE = """SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (error IS NULL) AS chunks_processed,
  CAST(coalesce(sum(total_input_tokens) FILTER (error IS NULL), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(response_tokens) FILTER (error IS NULL), 0) AS BIGINT) AS total_output_tokens,
  CAST(coalesce(sum(response_chars) FILTER (error IS NULL), 0) AS BIGINT) AS response_chars,
  sum(seconds) AS processing_time FROM resp GROUP BY doc_id"""
STATUS = """CASE WHEN chunks_processed = 0 OR response_chars = 0 THEN 'failed'
  WHEN chunks_processed < n_chunks THEN 'partial' ELSE 'ok' END"""


def block(before: str, after: str) -> str:
    return (
        f"{lit(budget.CONTINUITY_HEAD)} || {before} || {lit(budget.CONTINUITY_MIDDLE)} || {after}"
        f" || {lit(budget.CONTINUITY_TAIL)}"
    )


def window_before(values: str) -> str:
    return f"last_value({values} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


LOG = """SELECT user_id AS client, ts, event_id AS request_id, CAST(floor(value * 100) AS BIGINT) AS tokens, event_type,
  event_id % 17 <> 0 AS has_headers, event_id % 13 = 0 AS bad, event_id AS e FROM events"""
STATUS_LOG = f"""SELECT *, CASE WHEN parsed THEN e * 31 % 300 ELSE 0 END AS requests_remaining,
  CASE WHEN parsed THEN e * 7919 % 120000 ELSE 0 END AS tokens_remaining,
  CASE WHEN parsed THEN 400000::BIGINT ELSE 0::BIGINT END AS tokens_limit,
  CASE WHEN parsed THEN 1000::BIGINT ELSE 0::BIGINT END AS requests_limit,
  epoch_us(ts) AS at_us,
  epoch_us(ts) + CASE WHEN parsed AND e % 19 <> 0 THEN e % 60 * 1000000 + 500000 ELSE 60000000 END AS reset_us
  FROM (SELECT *, has_headers AND NOT bad AS parsed FROM ({LOG}))"""


def delay(need: str, now: str, p: str = "") -> str:
    """Delay ladder over status columns with prefix ``p``."""
    wait = f"(({p}reset_us - {now}) / 1000000.0::DOUBLE)"
    safe = "(400000 / 60.0::DOUBLE * 0.8::DOUBLE)"
    return f"""CASE WHEN NOT {p}parsed THEN 0.1
      WHEN {p}tokens_remaining < {need} AND {p}reset_us > {now} THEN least({wait}, 60.0)
      WHEN {p}tokens_remaining < {need} + 50000 AND {p}reset_us > {now} THEN least(greatest({wait} * 0.1, 1.0), 10.0)
      WHEN {p}tokens_limit > 0 AND ({now} - {p}at_us) / 1000000.0::DOUBLE < 1.0 AND {need} > {safe} AND {need} / {safe} - 1.0 > 0
        THEN least({need} / {safe} - 1.0, 2.0)
      WHEN {p}requests_remaining < 100 THEN 2.0 ELSE 0.1 END::DOUBLE"""


def quota(width_us: int, tokens: int, requests: int, by: str = "") -> str:
    extra = f", {by}" if by else ""
    return f"""SELECT epoch_us(ts) // {width_us} * {width_us} AS window_start{extra}, CAST(sum(tokens) AS BIGINT) AS tokens,
      count(*) AS requests, sum(tokens) > {tokens} AS tokens_over, count(*) > {requests} AS requests_over
      FROM ({LOG}) GROUP BY 1{', 2' if by else ''}"""


BOUNDARY = r"^(?:def |function |func |fn |public |private |protected |static |class |struct |interface |enum |import |include |require |using |namespace |module |package |/\*\*|\*/|###|///|from [^\n]* import|\s*$)"
KEYWORD = r"(?s)^\s*(?:def |class |function |public |private ).*\S"
SCAN = """regexp_replace(regexp_replace(s, '\\\\["'']', 'E', 'g'), '"[^"]*"|''[^'']*''', 'S', 'g')"""
FEATURES = f"""
  scanned AS (SELECT *, {SCAN} AS rest FROM lines),
  feats AS (
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, s, CAST(length(s) // 4 + 1 AS INTEGER) AS token_count,
      regexp_matches(s, '{BOUNDARY}') AS is_boundary, regexp_matches(s, '{KEYWORD}') AS is_keyword,
      CAST(length(replace(bare, '}}', '')) - length(replace(bare, '{{', '')) AS INTEGER) AS brace_delta,
      CAST(length(replace(bare, ')', '')) - length(replace(bare, '(', '')) AS INTEGER) AS paren_delta,
      quoted AS open_string
    FROM (SELECT *, regexp_matches(rest, '["'']') AS quoted, regexp_replace(rest, '(?s)["''].*$', '') AS bare FROM scanned)),
  depth AS (
    SELECT *, bs - least(0, min(bs) OVER w) AS brace_depth, ps - least(0, min(ps) OVER w) AS paren_depth
    FROM (SELECT *, sum(brace_delta) OVER w AS bs, sum(paren_delta) OVER w AS ps FROM feats
          WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def code_chunks(cs: int, stale: bool, words: bool = False) -> str:
    w = 4 * cs - 1
    size = N_WORDS.format("s") if words else "token_count"
    pieces = f"""SELECT doc_id, st, j, substr(s, j * {w} + 1, {w}), length(substr(s, j * {w} + 1, {w})) // 4 + 1
    FROM whole, unnest(range(0, (length(s) - 1) // {w} + 1)) AS u(j) WHERE solo"""
    if words:
        pieces = f"""SELECT doc_id, st, j, array_to_string(w[j * {cs} + 1 : (j + 1) * {cs}], ''), len(w[j * {cs} + 1 : (j + 1) * {cs}])
    FROM (SELECT *, {WORD_RUNS.format('s')} AS w FROM whole), unnest(range(0, (len(w) - 1) // {cs} + 1)) AS u(j) WHERE solo"""
    kept = "p_tk" if stale else "0"
    cut = "{{'st': {0}, 'n': {1}, 'tk': {2}, 'solo': {3}}}"
    none = "[]::STRUCT(st BIGINT, n BIGINT, tk BIGINT, solo BOOLEAN)[]"
    own = cut.format("i", "1::BIGINT", "k", "true")
    return f"""WITH RECURSIVE {lines(CODE_DOCS)}, {FEATURES},
  arr AS (
    SELECT doc_id, count(*) AS cnt, list(({size})::BIGINT ORDER BY line_no) AS ks, list(is_boundary ORDER BY line_no) AS bs,
      list(brace_depth = 0 AND paren_depth = 0 AND NOT open_string AND (is_boundary OR (line_no > 0 AND is_keyword)) ORDER BY line_no) AS gs
    FROM depth GROUP BY doc_id),
  walk AS (
    SELECT doc_id, -1::BIGINT AS i, 0::BIGINT AS st, 0::BIGINT AS n, 0::BIGINT AS tk, {none} AS e FROM arr
    UNION ALL
    SELECT doc_id, i,
      CASE WHEN k <= {cs} THEN p_st ELSE i + 1 END, CASE WHEN k <= {cs} THEN p_n ELSE 0 END,
      CASE WHEN k <= {cs} THEN p_tk WHEN p_n > 1 THEN 0 ELSE {kept} END,
      CASE WHEN k <= {cs} THEN p_e
           WHEN p_n > 1 THEN list_concat(p_e, [{cut.format('p_st', 'p_n - 1', 'p_tk - k', 'false')}, {own}])
           ELSE list_concat(p_e, [{own}]) END
    FROM (
      SELECT *,
        CASE WHEN NOT over THEN st WHEN g OR j IS NULL THEN i ELSE st + j END AS p_st,
        CASE WHEN NOT over THEN n + 1 WHEN g OR j IS NULL THEN 1 ELSE n - j + 1 END AS p_n,
        CASE WHEN NOT over THEN tk + k WHEN g OR j IS NULL THEN k ELSE list_sum(ks[st + j + 1 : i + 1])::BIGINT END AS p_tk,
        CASE WHEN NOT over THEN {none} WHEN g OR j IS NULL THEN [{cut.format('st', 'n', 'tk', 'false')}]
             ELSE [{cut.format('st', 'j', 'list_sum(ks[st + 1 : st + j])::BIGINT', 'false')}] END AS p_e
      FROM (
        SELECT *, CASE WHEN over AND NOT g AND n > 10
                       THEN list_max(list_filter(range(greatest(0, n - 20) + 1, n), lambda q: bs[st + q + 1])) END AS j
        FROM (
          SELECT w.doc_id, w.i + 1 AS i, w.st, w.n, w.tk, a.ks, a.bs, a.ks[w.i + 2] AS k, a.gs[w.i + 2] AS g,
                 w.n > 0 AND w.tk + a.ks[w.i + 2] > {cs} AS over
          FROM walk w JOIN arr a USING (doc_id) WHERE w.i + 1 < a.cnt)))),
  cuts AS (
    SELECT doc_id, unnest(e, recursive := true) FROM walk WHERE len(e) > 0
    UNION ALL
    SELECT w.doc_id, w.st, w.n, w.tk, false FROM walk w JOIN arr a USING (doc_id) WHERE w.i = a.cnt - 1 AND w.n > 0),
  whole AS (
    SELECT c.doc_id, c.st, c.tk, c.solo, string_agg(l.s, '' ORDER BY l.line_no) AS s
    FROM cuts c JOIN lines l ON l.doc_id = c.doc_id AND l.line_no >= c.st AND l.line_no < c.st + c.n GROUP BY ALL),
  parts AS (
    SELECT doc_id, st, 0 AS j, s, tk FROM whole WHERE NOT solo
    UNION ALL
    {pieces})
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st, j) - 1 AS INTEGER) AS chunk_index,
         s AS text, CAST(tk AS INTEGER) AS token_count FROM parts"""


def structure_chunks(src: str, runs: str, levels: str, cs: int = CS) -> str:
    """Structure chunkers: pieces by refinement, then one recursion step per chunk.

    ``runs`` is the regex that cuts a text, ``levels`` the break strength of a run
    in terms of s, nxt and is_last.
    """
    cap = 4 * cs

    def finer(source: str, pattern: str, inner: int) -> str:
        parts = f"regexp_extract_all(s, {lit(pattern)})" if pattern else (
            f"list_transform(range(0, (length(s) - 1) // {cap} + 1), lambda z: substr(s, CAST(z * {cap} + 1 AS BIGINT), {cap}))"
        )
        return f"""
      SELECT doc_id, list_append(pos, 0) AS pos, s, lvl FROM {source} WHERE {RTRIM} <= {cap}
      UNION ALL
      SELECT doc_id, list_append(pos, i), p[i], CASE WHEN i = len(p) THEN lvl ELSE {inner} END
      FROM (SELECT *, {parts} AS p FROM {source} WHERE {RTRIM} > {cap}), unnest(range(1, len(p) + 1)) AS u(i)"""

    return f"""WITH RECURSIVE src AS ({src}),
    cut0 AS (
      SELECT doc_id, i, p[i] AS s, coalesce(p[i + 1], '') AS nxt, i = len(p) AS is_last
      FROM (SELECT doc_id, regexp_extract_all(text, {lit(runs)}) AS p FROM src), unnest(range(1, len(p) + 1)) AS u(i)),
    p0 AS (SELECT doc_id, [i] AS pos, s, {levels} AS lvl FROM cut0),
    p1 AS ({finer('p0', cst.LINE_RUN, cst.NEWLINE)}),
    p2 AS ({finer('p1', cst.SENTENCE_RUN, cst.SENTENCE)}),
    p3 AS ({finer('p2', cst.WORD_RUN, cst.WORD)}),
    p4 AS ({finer('p3', '', 0)}),
    pieces AS (
      SELECT doc_id, s, lvl, row_number() OVER w - 1 AS idx, sum(length(s)) OVER w - length(s) AS start, {RTRIM} AS fit
      FROM p4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    walk AS (
      SELECT doc_id, 0::BIGINT AS st, 0::BIGINT AS n FROM src WHERE text <> ''
      UNION ALL
      SELECT w.doc_id, arg_max(p.idx, p.lvl * 10000000 + p.idx) + 1, w.n + 1
      FROM walk w JOIN pieces f ON f.doc_id = w.doc_id AND f.idx = w.st
      JOIN pieces p ON p.doc_id = w.doc_id AND p.idx >= w.st AND (p.idx = w.st OR p.start - f.start + p.fit <= {cap})
      GROUP BY w.doc_id, w.st, w.n),
    spans AS (SELECT doc_id, st, lead(st) OVER (PARTITION BY doc_id ORDER BY st) AS stop FROM walk),
    texts AS (
      SELECT c.doc_id, c.st, trim(string_agg(p.s, '' ORDER BY p.idx), {SPACES}) AS text
      FROM spans c JOIN pieces p ON p.doc_id = c.doc_id AND p.idx >= c.st AND p.idx < c.stop GROUP BY c.doc_id, c.st)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INTEGER) AS chunk_index, text,
      CAST(length(text) // 4 + 1 AS INTEGER) AS token_count FROM texts WHERE text <> ''"""


RTRIM = f"length(rtrim(translate(s, {NL} || chr(9) || chr(13), '   ')))"
SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS) + ")"
NEWLINES = f"(length(s) - length(rtrim(s, {NL})))"
PROSE_LEVELS = f"CASE WHEN {NEWLINES} = 0 THEN {cst.END} ELSE least({cst.NEWLINE - 1} + {NEWLINES}, {cst.BLOCK - 1}) END"


def either(pattern: str, *columns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {lit(pattern)})" for c in columns) + ")"


MARKDOWN_LEVELS = f"""CASE WHEN is_last THEN {cst.END}
  WHEN {either(cst.HEADING_LINE, 'nxt')} THEN {cst.HEADING} - length(regexp_extract(nxt, '^(#+)', 1))
  WHEN {either(cst.RULE_LINE, 'nxt', 's')} THEN {cst.RULE}
  WHEN {either(cst.HEADING_LINE, 's')} THEN {cst.NEWLINE}
  WHEN {NEWLINES} > 1 OR {either(cst.FENCE_LINE, 'nxt', 's')} THEN {cst.BLOCK}
  WHEN {either(cst.LIST_LINE, 'nxt')} THEN {cst.BLOCK - 1} ELSE {cst.NEWLINE} END"""

HEADING = r"^(#{1,6})(?:\s|$)"
MD_LINES = rf"""lines2 AS (
    SELECT *, regexp_matches(s, '^(?:```|~~~)') AS fence, regexp_matches(s, '{HEADING}') AS head FROM lines),
  marked AS (
    SELECT *, head AND sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 0 AS starts FROM lines2),
  sections AS (
    SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_id FROM marked)"""

CASES = " ".join(f"WHEN {i} THEN {lit(t.lower())}" for i, t in enumerate(ERROR_TEXTS))


def has(words) -> str:
    return "(" + " OR ".join(f"m LIKE '%{w.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for w in words) + ")"


UPPER = "upper(replace(text, 'ß', 'SS'))"

# The plan in one scan per client: limits 9000 tokens and 3 requests a minute, the largest request up to 4500 in reserve.
DISPATCH = f"""WITH log AS ({LOG}),
    steps AS (
      SELECT client, ts, request_id, tokens, tokens > 9000 AS over_limit, epoch_us(ts) AS arrival,
        CASE WHEN tokens > 9000 THEN 0 WHEN tokens > 4500 THEN 60000000 ELSE greatest(20000000,
          CAST(ceil((tokens * 60000000)::DOUBLE / (9000 - (SELECT max(tokens) FROM log WHERE tokens <= 4500))) AS BIGINT)) END AS share,
        CASE WHEN tokens > 4500 AND tokens <= 9000 THEN 60000000 ELSE 0 END AS pause FROM log),
    summed AS (SELECT *, CAST(sum(share + pause) OVER w AS BIGINT) AS total FROM steps WINDOW w AS (PARTITION BY client ORDER BY ts, request_id)),
    plan AS (
      SELECT client, request_id, tokens, over_limit, CASE WHEN NOT over_limit THEN
        total + max(CASE WHEN NOT over_limit THEN arrival + share - total END) OVER (PARTITION BY client ORDER BY ts, request_id) - share END AS dispatch_at
      FROM summed)"""

ORACLES = {
    "match_patterns": rf"""SELECT rel_path, rel_path LIKE '%.md' OR rel_path LIKE '%.txt' AS flat,
      regexp_matches(rel_path, '(^|/)src1[^/]*/.*\.md$') AS deep,
      regexp_matches(rel_path, '(^|/)[ac]/[^/]\.log$') AS classes, contains(rel_path, '/.git/') AS in_git FROM ({PATHS})""",
    "discover": f"""SELECT rel_path, length, '/out/' || rel_path AS output_path FROM ({FILES}) WHERE rel_path LIKE '%.md'""",
    "file_info": f"SELECT rel_path, length, true AS has_time FROM ({FILES})",
    "expand_patterns": f"SELECT doc_id, rel_path || '/*.' || unnest(['md', 'py']) AS expanded FROM ({PATHS})",
    "pattern_union": rf"""SELECT DISTINCT rel_path FROM ({PATHS}) WHERE (rel_path LIKE '%.md' OR rel_path LIKE 'src1/%')
      AND NOT contains(rel_path, '/.git/')""",
    "ignore_filter": rf"""SELECT rel_path FROM ({PATHS}) WHERE NOT CASE WHEN rel_path LIKE 'src1/en/%' THEN true
      WHEN contains(rel_path, '/build/') THEN true WHEN regexp_matches(rel_path, '/7[^/]*\.log$') THEN false
      ELSE rel_path LIKE '%.log' END""",
    "map_paths": f"SELECT '/in/' || rel_path AS path, '/out/' || rel_path AS mirrored, '/in/' || rel_path AS in_place FROM ({PATHS})",
    "prescreen": f"""SELECT '/in/' || rel_path AS path, CASE WHEN doc_id % 5 = 0 THEN '/in/' ELSE '/out/' END || rel_path AS output_path
      FROM ({PATHS}) WHERE doc_id % 5 = 0 OR doc_id % 2 = 1""",
    "resume_pending": "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 48 <= 24)",
    "read_docs": """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN text END AS text,
      CASE WHEN doc_id % 50 = 0 THEN 'not valid UTF-8' END AS error FROM documents""",
    "size_guard": """SELECT doc_id, n_chars AS length,
      CASE WHEN n_chars > 2000 THEN 'File too large: ' || n_chars || ' bytes > 2000' END AS error FROM documents""",
    "write_docs": DOCS,
    "write_doc_files": "SELECT doc_id, strlen(text)::BIGINT AS bytes, NULL::VARCHAR AS error FROM documents",
    "empty_docs": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS output_text,
      CASE WHEN doc_id % 10 = 0 OR text = '' THEN 'empty' ELSE 'ok' END AS status FROM documents""",
    "greedy_pack": f"""WITH RECURSIVE {lines(DOCS)},
      items AS (SELECT doc_id, line_no AS r, length(s) // 4 + 1 AS k FROM lines),
      walk AS (
        SELECT doc_id, r, k, k AS tk, 0 AS c FROM items WHERE r = 0
        UNION ALL
        SELECT i.doc_id, i.r, i.k, CASE WHEN w.tk + i.k > {CS} THEN i.k ELSE w.tk + i.k END,
               w.c + CASE WHEN w.tk + i.k > {CS} THEN 1 ELSE 0 END
        FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.r = w.r + 1)
      SELECT doc_id, CAST(c AS INTEGER) AS group_index, CAST(min(r) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS n_lines,
             CAST(max(tk) AS INTEGER) AS token_count, max(k) > {CS} AS solo FROM walk GROUP BY doc_id, c""",
    "chunk_text": ALL_CHUNKS,
    "chunk_lines": ALL_CHUNKS,
    "sql_chunk_text": ALL_CHUNKS,
    "chunk_semantic": ALL_CHUNKS,
    "stream_chunks": ALL_CHUNKS,
    "chunk_markdown": f"{chunk_ctes(MD_DOCS)} SELECT {CHUNK_COLUMNS} FROM chunks",
    "split_overlong": f"""SELECT doc_id, CAST(j AS INTEGER) AS chunk_index, substr(text, j * {4 * CS - 1} + 1, {4 * CS - 1}) AS text,
      CAST(length(substr(text, j * {4 * CS - 1} + 1, {4 * CS - 1})) // 4 + 1 AS INTEGER) AS token_count
      FROM documents, unnest(range(0, (length(text) - 1) // {4 * CS - 1} + 1)) AS u(j) WHERE text <> ''""",
    "chunk_paragraph": f"""WITH RECURSIVE src AS ({MD_DOCS}),
      parts AS (SELECT doc_id, i AS r, p[i] AS s, length(p[i]) AS n
        FROM (SELECT doc_id, string_split(text, {NL} || {NL}) AS p FROM src), unnest(range(1, len(p) + 1)) AS u(i)),
      walk AS (
        SELECT doc_id, r, n::BIGINT AS ln, 0 AS c FROM parts WHERE r = 1
        UNION ALL
        SELECT i.doc_id, i.r,
          CASE WHEN w.ln + i.n > {4 * CS} OR w.ln = 0 THEN i.n ELSE w.ln + i.n + 2 END,
          w.c + CASE WHEN w.ln + i.n > {4 * CS} OR w.ln = 0 THEN 1 ELSE 0 END
        FROM walk w JOIN parts i ON i.doc_id = w.doc_id AND i.r = w.r + 1),
      joined AS (SELECT doc_id, c, string_agg(s, {NL} || {NL} ORDER BY r) AS t FROM walk JOIN parts USING (doc_id, r) GROUP BY doc_id, c),
      kept AS (SELECT doc_id, c, {BODY.replace('text', 't')} AS text FROM joined WHERE t <> '')
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS INTEGER) AS chunk_index, text,
             CAST(length(text) // 4 + 1 AS INTEGER) AS token_count FROM kept""",
    "chunk_code": code_chunks(CS, False),
    "chunk_text_words": f"WITH RECURSIVE {lines(DOCS)}, {packed_words(WORDS_CS)} SELECT {CHUNK_COLUMNS} FROM chunks",
    "chunk_code_words": code_chunks(WORDS_CS, False, True),
    "split_overlong_words": f"""WITH d AS (SELECT doc_id, text, {N_WORDS.format('text')} AS n, {WORD_RUNS.format('text')} AS w FROM documents)
      SELECT doc_id, CAST(j AS INTEGER) AS chunk_index, CASE WHEN n > {WORDS_CS} THEN array_to_string(w[j * {WORDS_CS} + 1 : (j + 1) * {WORDS_CS}], '') ELSE text END AS text,
        CAST(CASE WHEN n > {WORDS_CS} THEN len(w[j * {WORDS_CS} + 1 : (j + 1) * {WORDS_CS}]) ELSE n END AS INTEGER) AS token_count
      FROM d, unnest(range(0, greatest(1, (n - 1) // {WORDS_CS} + 1))) AS u(j) WHERE text <> ''""",
    "tail_sample_words": rf"""SELECT doc_id, CASE WHEN len(w) > {SAMPLE} THEN right(text, length(array_to_string(w[-{SAMPLE}:], '')) + length(regexp_extract(text, '[\x20\x09-\x0D]*$'))
      + length(regexp_extract(w[-{SAMPLE} - 1], '[\x20\x09-\x0D]*$'))) ELSE text END AS tail
      FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w FROM documents)""",
    "job_documents": f"""{CHUNKS} SELECT doc_id, count(c.doc_id) AS n_chunks, d.text AS output_text,
      CASE WHEN count(c.doc_id) = 0 THEN 'empty' ELSE 'ok' END AS status FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY doc_id, d.text""",
    "job_failures": f"""{CHUNKS} SELECT doc_id, chunk_index + 1 AS chunk_number, 'refused' AS error FROM chunks WHERE starts_with(text, 'D')""",
    # A document that fails wholly adds nothing; one without text counts as done.
    "job_summary": f"""{CHUNKS}, st AS (SELECT doc_id, count(*) FILTER (NOT starts_with(c.text, 'D')) AS done,
          CAST(coalesce(sum(length(c.text) // 4 + 1) FILTER (NOT starts_with(c.text, 'D')), 0) AS BIGINT) AS tokens, count(c.doc_id) AS n
        FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY doc_id)
      SELECT count(*) FILTER (done > 0 OR n = 0) AS successful, count(*) FILTER (done = 0 AND n > 0) AS failed,
        CAST(sum(tokens) AS BIGINT) AS total_output_tokens FROM st""",
    "folder_outputs": f"""SELECT rel_path, upper(replace(text, 'ß', 'SS')) AS text FROM ({FILES.replace(' FROM documents', ", CASE WHEN doc_id % 10 = 1 THEN '' ELSE text END AS text FROM documents")})
      WHERE rel_path LIKE '%.md'""",
    # Documents of one text are one in the log.
    "run_progress": f"""{CHUNKS}, c AS (SELECT DISTINCT d.text AS whole, c.chunk_index, c.text, c.token_count FROM chunks c JOIN documents d USING (doc_id))
      SELECT count(*) AS answers, count(*) FILTER (text LIKE 'D%') AS failed_answers, count(DISTINCT whole) AS documents,
        CAST(sum(token_count) AS BIGINT) AS chunk_tokens FROM c""",
    "dehyphenate": rf"SELECT doc_id, regexp_replace(text, '(\p{{L}})-\n[ \t\r\n]*(\p{{Ll}})', '\1\2', 'g') AS text FROM ({BROKEN_DOCS})",
    "clean_spacing": rf"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n ?(?:\n ?)+', {NL} || {NL}, 'g') AS text FROM ({BROKEN_DOCS})",
    "drop_page_numbers": rf"""SELECT doc_id, array_to_string(list_filter(string_split(text, {NL}),
        lambda s: NOT regexp_full_match(s, '[ \t]*([Pp]age|[Ss]eite|[Pp]ágina)?[ \t]*-?[ \t]*[0-9]{{1,4}}[ \t]*-?[ \t\r]*')), {NL}) AS text FROM ({BROKEN_DOCS})""",
    "drop_garble": rf"SELECT doc_id, regexp_replace(text, '[■□▪▫\x{{FFFD}}]+|\?{{4,}}', '', 'g') AS text FROM ({BROKEN_DOCS})",
    # Without look-around, a line of one letter needs a second pass.
    "merge_lines": rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '([^.!?:;\n])\n(\p{{L}})', '\1 \2', 'g'), '([^.!?:;\n])\n(\p{{L}})', '\1 \2', 'g') AS text
      FROM ({BROKEN_DOCS})""",
    "drop_repeated_lines": f"""WITH l AS (SELECT doc_id, source, i, p[i] AS s FROM (SELECT doc_id, source, string_split(text, {NL}) AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i)),
      size AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
      common AS (SELECT source, s FROM l JOIN size USING (source) WHERE trim(s) <> '' GROUP BY source, s, size HAVING count(DISTINCT doc_id) >= 3 AND 100 * count(DISTINCT doc_id) >= 2 * size)
      SELECT doc_id, coalesce(string_agg(l.s, {NL} ORDER BY i) FILTER (c.s IS NULL), '') AS text, count(c.s) AS n_dropped
      FROM l LEFT JOIN common c ON l.source = c.source AND l.s = c.s GROUP BY doc_id""",
    "resumed_run": """SELECT doc_id, text AS output_text, CASE WHEN text = '' THEN NULL WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS models FROM documents""",
    "chunk_code_reference_tally": code_chunks(20, True),
    "code_line_features": f"""WITH {lines(CODE_DOCS)}, {FEATURES}
      SELECT doc_id, line_no, token_count, is_boundary, is_keyword, brace_delta, paren_delta, open_string FROM feats""",
    "code_depth": f"""WITH {lines(CODE_DOCS)}, {FEATURES}
      SELECT doc_id, line_no, CAST(brace_depth AS INTEGER) AS brace_depth, CAST(paren_depth AS INTEGER) AS paren_depth FROM depth""",
    "chunk_semantic_structure": structure_chunks(DOCS, cst.LINE_RUN, PROSE_LEVELS),
    "chunk_markdown_structure": structure_chunks(MD_DOCS, cst.FENCE_RUN, MARKDOWN_LEVELS),
    "md_sections": rf"""WITH {lines(MD_DOCS)}, {MD_LINES}
      SELECT doc_id, CAST(section_id AS INTEGER) AS section_id,
        CAST(max(CASE WHEN starts THEN length(regexp_extract(s, '{HEADING}', 1)) ELSE 0 END) AS INTEGER) AS heading_level,
        max(CASE WHEN starts THEN regexp_replace(regexp_replace(s, '^#+', ''), '^\s+|\s+$', '', 'g') ELSE '' END) AS title,
        count(*) AS n_lines, CAST(sum(length(s) // 4 + 1) AS BIGINT) AS n_tokens FROM sections GROUP BY doc_id, section_id""",
    # Every page opens with a declaration that never closes: no top-level element exists.
    "chunk_xml": f"""{chunk_ctes("SELECT page_id AS doc_id, '<x>' || html || '</x>' AS text FROM pages")}
      SELECT {CHUNK_COLUMNS} FROM chunks JOIN src s USING (doc_id, text) WHERE false
      UNION ALL SELECT c.doc_id, c.chunk_index, c.text, c.token_count FROM chunks c JOIN src s USING (doc_id) WHERE length(s.text) // 4 + 1 > {CS}
      UNION ALL SELECT doc_id, 0, text, CAST(length(text) // 4 + 1 AS INTEGER) FROM src WHERE length(text) // 4 + 1 <= {CS}""",
    "xml_normalize": "SELECT page_id AS doc_id, '<x>' || html || '</x>' AS xml FROM pages",
    "xml_normalize_text": """SELECT doc_id, '<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
      '"', '&quot;'), '''', '&apos;') || '</p>' AS xml FROM documents""",
    "xml_spans": f"""WITH e AS ({ELEMENTS})
      SELECT doc_id, CAST(stop - length(s) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end"
      FROM (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM e)""",
    "xml_pack": XML_PACK,
    "chunk_xml_children": XML_PACK,
    "norm_newlines": DOCS,
    "token_count": "SELECT doc_id, CAST(length(text) // 4 + 1 AS INTEGER) AS tokens FROM documents",
    "split_lines": f"WITH {lines(DOCS)} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, s AS line FROM lines",
    "blank_chunks": rf"""{chunk_ctes(MD_DOCS, 2)} SELECT doc_id, count(*) FILTER (regexp_matches(text, '^\s*$')) AS n_blank, count(*) AS n
      FROM chunks GROUP BY doc_id""",
    "tail_sample": f"{CHUNKS} SELECT doc_id, chunk_index, right(text, {4 * SAMPLE}) AS tail FROM chunks",
    "continuity_block": f"""{CHUNKS} SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 AND text <> '' THEN
      {block(f'right(text, {4 * SAMPLE})', f'right(text, {4 * SAMPLE})')} ELSE '' END AS block FROM chunks""",
    "fit_budget": """SELECT doc_id, CASE WHEN base + length(text) // 4 + 1 <= 131000 THEN text WHEN base >= 131000 THEN ''
      WHEN k IS NOT NULL AND (length(text) >> k) // 4 + 1 >= 20 THEN left(text, length(text) >> k) ELSE '' END AS fitted
      FROM (SELECT *, list_filter(range(1, 32), lambda k: base + (length(text) >> k::BIGINT) // 4 + 1 <= 131000)[1] AS k
        FROM (SELECT doc_id, text, 131000 - doc_id * 37 % 2000 AS base FROM documents))""",
    "continuity_budget": """SELECT doc_id, CAST(greatest(0, least(131000 - (length(text) // 4 + 1) - 129500 - 1000, 400)) AS INTEGER) AS budget
      FROM documents""",
    "completion_budget": """SELECT doc_id, CAST(least(40000, greatest(k * (doc_id % 900 + 1) // 100, (k * 450 + 99) // 100, 4096)) AS INTEGER) AS budget
      FROM (SELECT doc_id, length(text) // 4 + 1 AS k FROM documents)""",
    "model_budget": """SELECT doc_id, CAST(least(least(40000, greatest(k, (k * 450 + 99) // 100, 4096)), CASE WHEN doc_id % 2 = 0 THEN 2048 ELSE 40960 END) AS INTEGER) AS budget
      FROM (SELECT doc_id, length(text) // 4 + 1 AS k FROM documents)""",
    "chunk_preview": f"""{chunk_ctes(MD_DOCS)} SELECT doc_id, chunk_index, CASE WHEN length(h) > 200 THEN left(h, 200) || '...' ELSE h END AS preview
      FROM (SELECT doc_id, chunk_index, array_to_string(string_split(text, {NL})[1:5], {NL}) AS h FROM chunks)""",
    "frontmatter_parse": f"SELECT doc_id, {FRONT_JSON} AS metadata, {BODY} AS body FROM ({FRONT})",
    "frontmatter_render": rf"""SELECT doc_id, '---' || {NL} || 'author: ' || source || {NL}
      || CASE WHEN whole THEN 'date: 2024-01-05' || {NL} ELSE '' END || 'draft: ' || (doc_id % 2 = 0) || {NL} || 'empty: null' || {NL}
      || CASE WHEN whole THEN 'id: D' || doc_id || {NL} ELSE '' END || 'n: ' || doc_id || {NL} || 'note: ''no''' || {NL} || 'ratio: 2.5' || {NL}
      || CASE WHEN doc_id % 4 = 0 THEN 'tags: ["a",7,{{"k":"v"}}]' || {NL} ELSE '' END
      || 'title: T' || doc_id || {NL} || 'type: ' || lang || {NL} || '---' || {NL} || {NL} || {BODY} AS text FROM ({FRONT})""",
    "metadata_complete": f"SELECT doc_id, whole AS complete, CASE WHEN whole THEN '' ELSE 'date,id' END AS missing FROM ({FRONT})",
    "metadata_missing_rows": f"SELECT doc_id, unnest(['date', 'id']) AS field FROM ({FRONT}) WHERE NOT whole",
    "metadata_context": f"SELECT doc_id, '{metadata.CONTEXT_HEAD}' || {FRONT_JSON} || {NL} || {NL} AS context FROM ({FRONT})",
    "metadata_merge": f"""SELECT doc_id, '{{"title":"T' || doc_id || '","author":"A' || doc_id || '","type":"' || lang || '"' || {OTHER_JSON}
      || CASE WHEN whole THEN ',"id":"D' || doc_id || '"' ELSE '' END || ',"date":"today"}}' AS metadata FROM ({FRONT})""",
    "explain_prompt": f"""{chunk_ctes(f"SELECT doc_id, {BODY} AS text FROM documents", 2000)}
      SELECT doc_id, {lit(metadata.EXPLAIN_TASK)} || {FRONT_JSON} || {lit(metadata.EXPLAIN_CHUNK)}
        || CASE WHEN length(c.text) > 4000 THEN left(c.text, 4000) || '...' ELSE c.text END || {lit(metadata.EXPLAIN_END)} AS prompt
      FROM (SELECT doc_id, text FROM chunks WHERE chunk_index = 0) c JOIN (SELECT * EXCLUDE (text) FROM ({FRONT})) USING (doc_id)""",
    "explain_flow": f"""SELECT doc_id, CASE WHEN whole THEN {FRONT_JSON} ELSE '{{"title":"{GENERATED['title']}","author":"{GENERATED['author']}","type":"{GENERATED['type']}"'
      || {OTHER_JSON} || ',"id":"{GENERATED['id']}","date":"{GENERATED['date']}"}}' END AS metadata FROM ({FRONT})""",
    "build_requests": f"""{CHUNKS}, r AS (
        SELECT c.doc_id, chunk_index, token_count, '{metadata.CONTEXT_HEAD}' || '{{"source":"' || source || '"}}' || {NL} || {NL} || c.text AS u
        FROM chunks c JOIN documents d USING (doc_id)),
      t AS (SELECT *, 130901 + length(u) // 4 + 1 AS total FROM r)
      SELECT doc_id, chunk_index, CAST(total AS INTEGER) AS total_input_tokens,
        CAST(least(40000, greatest(token_count, (token_count * 450 + 99) // 100, 4096)) AS INTEGER) AS max_completion_tokens,
        CASE WHEN total <= 131000 THEN u END AS user_content,
        CASE WHEN total > 131000 THEN 'Input too large: ' || total || ' tokens > 131000 limit' END AS error FROM t""",
    "continuity_replay": f"""{responses()} SELECT doc_id, chunk_index, CASE WHEN a <> '' AND b <> '' THEN {block('a', 'b')} ELSE '' END AS continuity
      FROM (SELECT doc_id, chunk_index,
              {window_before(f"CASE WHEN error IS NULL THEN right(text, {4 * SAMPLE}) END")} AS a,
              {window_before(f"CASE WHEN error IS NULL THEN right(response, {4 * SAMPLE}) END")} AS b FROM resp)""",
    "attach_responses": f"""{responses()} SELECT doc_id, chunk_index, text, CASE WHEN chunk_index % 4 <> 3 THEN response END AS response,
      CASE WHEN chunk_index % 4 <> 3 THEN error END AS error FROM resp""",
    "transform_identity": "SELECT doc_id, text AS output_text FROM documents WHERE text <> ''",
    "transform_upper": f"{CHUNKS} SELECT doc_id, chunk_index, {UPPER} AS response FROM chunks",
    "chunk_diagnostics": f"""{CHUNKS} SELECT doc_id, CAST(chunk_index + 1 AS INTEGER) AS chunk_index, token_count AS chunk_tokens,
        CAST(1 + (length(text) + coalesce(length({block('tail', 'tail')}), 0)) // 4 + 1 AS INTEGER) AS total_input_tokens,
        CAST(least(40000, greatest(token_count, (token_count * 450 + 99) // 100, 4096)) AS INTEGER) AS max_completion_tokens,
        CAST(length(text) // 4 + 1 AS INTEGER) AS response_tokens, CAST(length(text) AS INTEGER) AS response_chars,
        'primary' AS model, 0.98::DOUBLE AS temperature, false AS rate_headers_parsed
      FROM (SELECT *, right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), {4 * SAMPLE}) AS tail FROM chunks)""",
    "fallback_pick": f"""{CHUNKS}, a AS (
        SELECT doc_id, chunk_index, CAST(j AS INTEGER) AS j, (doc_id + chunk_index + j * 5) % 4 < 2 AS bad FROM chunks, unnest(range(0, 3)) AS u(j))
      SELECT doc_id, chunk_index, 'm' || min(j) FILTER (NOT bad) AS model, 'r' || min(j) FILTER (NOT bad) AS response, count(*) AS n_attempts
      FROM a GROUP BY doc_id, chunk_index""",
    "error_placeholder": f"{responses()} SELECT doc_id, chunk_index, coalesce(response, {NOTE}) AS output FROM resp",
    "reassemble": f"""{responses()} SELECT doc_id, count(*) AS n_chunks, string_agg(coalesce(response, {NOTE}), '' ORDER BY chunk_index) AS output_text
      FROM resp GROUP BY doc_id""",
    "conversation_requests": f"""SELECT conv_id, count(*) AS n_messages, CAST(sum(k) AS BIGINT) AS total_tokens, sum(k) > 131000 AS over_limit,
      CASE WHEN sum(k) > 131000 THEN 'Input too large: ' || sum(k) || ' tokens > 131000 limit' END AS error,
      CASE WHEN sum(k) <= 131000 THEN string_agg(role || ': ' || text, {NL} ORDER BY turn) END AS transcript
      FROM (SELECT *, length(text) // 4 + 1 AS k FROM conversations) GROUP BY conv_id""",
    "parse_rate_headers": f"""SELECT request_id, requests_remaining, tokens_remaining, tokens_limit, requests_limit, parsed AS headers_parsed,
      reset_us, at_us + 86400000000 AS requests_reset_us FROM ({STATUS_LOG})""",
    "backoff_delay": f"SELECT request_id, round({delay('need', 'now')}, 6) AS delay FROM (SELECT *, tokens * 20 AS need, at_us + e % 3 * 400000 AS now FROM ({STATUS_LOG}))",
    "rate_exhausted": f"""SELECT request_id, tokens_remaining < tokens * 20 AS tokens_exhausted, requests_remaining <= 0 AS requests_exhausted,
      greatest(0.0::DOUBLE, (reset_us - at_us - 20000000) / 1000000.0::DOUBLE) AS seconds_left FROM ({STATUS_LOG})""",
    "classify_errors": f"""SELECT request_id, {has(('rate limit', 'rate_limit', 'too many requests', '429'))} AS rate_limit, {has(('quota', 'daily limit', 'tokens per day limit'))} AS quota,
      {has(('server error', 'please try again', 'internal error', 'error code: 500'))} AS server,
      {has(('rate limit', '429', 'quota', 'please try again', 'internal error', 'error code: 500'))} OR code IN (500, 502, 503, 504, 429) AS retryable,
      code IN (503, 502, 504, 429) AS retry_metadata
      FROM (SELECT event_id AS request_id, CASE event_id % 6 {CASES} END AS m, [200, 400, 429, 502, 500][event_id % 5 + 1] AS code FROM events)""",
    "quota_usage": f"""SELECT request_id, used_percent, used_percent > 80 AS warn FROM (SELECT request_id,
      CASE WHEN requests_limit > 0 THEN round((requests_limit - requests_remaining) / requests_limit * 100.0::DOUBLE, 6) END AS used_percent FROM ({STATUS_LOG}))""",
    "pacing_replay": f"""SELECT request_id, CASE WHEN l_parsed IS NULL THEN 0.0::DOUBLE ELSE round({delay('tokens', 'at_us', 'l_')}, 6) END AS delay FROM (
      SELECT *, {', '.join(f'lag({c}) OVER w AS l_{c}' for c in ('parsed', 'tokens_remaining', 'reset_us', 'tokens_limit', 'at_us', 'requests_remaining'))}
      FROM ({STATUS_LOG}) WINDOW w AS (PARTITION BY client ORDER BY ts, request_id))""",
    "pacing_plan": f"""SELECT client, request_id, CAST(tk AS BIGINT) AS tokens_so_far, n AS requests_so_far,
      CAST(greatest((tk - tokens) // 5000, (n - 1) // 3) AS BIGINT) AS dispatch_minute FROM (
      SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS tk, count(*) OVER w AS n FROM ({LOG}) WINDOW w AS (PARTITION BY client ORDER BY ts, request_id))""",
    "dispatch_plan": f"{DISPATCH} SELECT client, request_id, tokens, over_limit, dispatch_at FROM plan",
    "dispatch_minutes": f"""{DISPATCH} SELECT client, dispatch_at // 60000000 AS minute, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests,
      0::BIGINT AS early, true AS within FROM plan WHERE NOT over_limit GROUP BY ALL""",
    "quota_by_minute": quota(60_000_000, 5_000, 1),
    "quota_by_day": quota(86_400_000_000, 500_000, 300, "client"),
    "chunk_stats": f"""{CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens,
      sum(token_count)::DOUBLE / count(*) AS avg_tokens FROM chunks GROUP BY doc_id""",
    "chunk_stats_by_language": f"""{CHUNKS} SELECT lang, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens,
      sum(token_count)::DOUBLE / count(*) AS avg_tokens FROM chunks JOIN documents d USING (doc_id) GROUP BY lang""",
    "dry_run_report": f"""{CHUNKS} SELECT 'text' AS data_format, count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS total_input_tokens,
      CAST(sum(token_count) // count(*) AS BIGINT) AS avg_chunk_size, max(token_count) AS max_chunk_size, min(token_count) AS min_chunk_size,
      count(*) AS estimated_calls, CAST(sum(token_count) + 12 * count(*) AS BIGINT) AS estimated_input_tokens FROM chunks""",
    "doc_state": f"""{responses()}, st AS ({STATE}) SELECT *,
      CASE WHEN chunks_processed = 0 THEN 0.0::DOUBLE ELSE total_input_tokens::DOUBLE / chunks_processed END AS avg_input_tokens,
      CASE WHEN chunks_processed = 0 THEN 0.0::DOUBLE ELSE total_output_tokens::DOUBLE / chunks_processed END AS avg_output_tokens,
      {STATUS} AS status FROM st""",
    "run_summary": f"""{responses()}, st AS ({STATE}), s AS (SELECT *, {STATUS} AS status FROM st)
      SELECT count(*) FILTER (status <> 'failed') AS successful, count(*) FILTER (status = 'failed') AS failed,
        CAST(sum(total_input_tokens) FILTER (status <> 'failed') AS BIGINT) AS total_input_tokens,
        CAST(sum(total_output_tokens) FILTER (status <> 'failed') AS BIGINT) AS total_output_tokens,
        sum(processing_time) FILTER (status <> 'failed') AS total_time,
        sum(processing_time) FILTER (status <> 'failed') / count(*) FILTER (status <> 'failed') AS avg_time FROM s""",
    "zero_output_docs": f"""{responses()}, z AS (
        SELECT doc_id, chunk_index, CASE WHEN doc_id % 9 = 0 THEN 'server error: down' ELSE error END AS error, response_chars FROM resp)
      SELECT doc_id, count(*) AS n_chunks, string_agg((chunk_index + 1) || ': ' || coalesce(error, 'no text'), {NL} ORDER BY chunk_index) FILTER (chunk_index < 3) AS shown,
        greatest(0, count(*) - 3) AS n_more FROM z GROUP BY doc_id HAVING count(*) FILTER (error IS NULL AND response_chars > 0) = 0""",
    "throughput": f"""{responses('lang')} SELECT lang, CAST(sum(response_tokens) AS BIGINT) AS output_tokens,
      round(sum(response_tokens)::DOUBLE / sum(seconds), 6) AS tokens_per_second FROM resp GROUP BY lang""",
    "model_usage": f"""{responses()} SELECT model, count(*) AS n_chunks, CAST(sum(total_input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(response_tokens) AS BIGINT) AS output_tokens FROM resp WHERE error IS NULL GROUP BY model""",
    "failures": f"{responses()} SELECT doc_id, CAST(chunk_index + 1 AS INTEGER) AS chunk_number, error FROM resp WHERE error IS NOT NULL",
    "progress": f"""{CHUNKS} SELECT doc_id, chunk_index, chunk_index + 1 AS done, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total,
      CAST(count(*) OVER (PARTITION BY doc_id) - chunk_index - 1 AS INTEGER) AS remaining FROM chunks""",
    "topk_preview": f"""{CHUNKS}, r AS (
        SELECT source, doc_id, chunk_index, token_count, count(*) OVER (PARTITION BY source) AS n,
          CAST(row_number() OVER (PARTITION BY source ORDER BY token_count DESC, doc_id, chunk_index) AS INTEGER) AS rank
        FROM chunks JOIN documents d USING (doc_id))
      SELECT source, doc_id, chunk_index, token_count, rank, greatest(0, n - 3) AS n_more FROM r WHERE rank <= 3""",
    "stream_continuity": f"""{CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens,
      max(chunk_index) AS last_index, right(arg_max(text, chunk_index), {4 * SAMPLE}) AS last_text FROM chunks GROUP BY doc_id""",
    # Only windows the watermark (latest time less five minutes) has passed are complete.
    "stream_quota": f"""SELECT * FROM ({quota(60_000_000, 5_000, 1)})
      WHERE window_start + 60000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 300000000 FROM events)""",
    "stream_dedup_outputs": DOCS,
    "sql_functions": f"""SELECT doc_id, CAST(length(text) // 4 + 1 AS INTEGER) AS tokens,
      CAST(least(40000, greatest(length(text) // 4 + 1, ((length(text) // 4 + 1) * 450 + 99) // 100, 4096)) AS INTEGER) AS budget,
      CAST(j AS INTEGER) AS piece_index, substr(text, j * {4 * CS - 1} + 1, {4 * CS - 1}) AS piece,
      CAST(length(substr(text, j * {4 * CS - 1} + 1, {4 * CS - 1})) // 4 + 1 AS INTEGER) AS piece_tokens
      FROM documents, unnest(range(0, (length(text) - 1) // {4 * CS - 1} + 1)) AS u(j) WHERE text <> ''""",
}
