import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from edge_rows import empty, rows, table
from xxhash import xxh64_intdigest

from foliospark.llm import exact_dedup, graph, simhash, suffix_dedup


# --- exact ---


def test_exact_groups(spark):
    data = rows()
    got = exact_dedup.exact_groups(table(spark), counters=4).collect()
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(data)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == digest]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {r.keep_id for r in mine} == {max(known) if known else None}
        assert {r.group_size for r in mine} == {len(ids)}
        kept = [r for r in mine if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == (max(known) if known else None)


def test_exact_drop_keeps_columns_and_one_row_each(spark):
    docs = table(spark)
    kept = exact_dedup.drop_exact_copies(docs, counters=4)
    assert kept.schema == docs.schema
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in rows()})


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def test_misra_gries_finds_every_frequent_value(spark):
    rng = random.Random(1)
    values = ["hot"] * 500 + ["warm"] * 300 + [f"v{rng.randrange(4000)}" for _ in range(1200)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "k string").repartition(7)
    found = {r.digest for r in exact_dedup.misra_gries(df, "k", 12).collect()}
    assert len(found) <= 12 and {"hot", "warm"} <= found


# --- components ---


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(50)] + [(5, 5), (None, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash ---


def plain_fingerprint(text: str) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, c in zip(ids, label):
        if i is not None and (least.get(c) is None or i < least[c]):
            least[c] = i
        least.setdefault(c, None)
    return [least[c] for c in label], label


def test_fingerprints_and_components(spark):
    data = [r for r in rows(n=40) if len(r[1] or "") < 5000]
    got = simhash.near_groups(table(spark, data)).collect()
    prints = [plain_fingerprint(r[1] or "") for r in data]
    component, _ = plain_components([r[0] for r in data], prints)
    want = sorted(((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(data, prints, component)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_near_drop(spark):
    data = [r for r in rows(n=40) if len(r[1] or "") < 5000]
    docs = table(spark, data)
    kept = simhash.drop_near_copies(docs)
    assert kept.schema == docs.schema
    _, label = plain_components([r[0] for r in data], [plain_fingerprint(r[1] or "") for r in data])
    by_row = {(r[0], r[1]): c for r, c in zip(data, label)}
    got = [by_row[r.doc_id, r.text] for r in kept.collect()]
    assert sorted(got) == sorted(set(label))


def test_simhash_empty(spark):
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_divided_buckets_lose_no_link(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size=12, dtype=np.uint64)
    fp = base[rng.integers(0, 12, 240)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64))
    fp = np.unique(fp)
    df = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.fingerprint_edges(df, bucket_rows=5 if seed % 2 else 20_000)).collect()}
    _, label = plain_components(list(range(len(fp))), [int(f) for f in fp])
    mine = [roots.get(int(f), int(f)) for f in fp.view(np.int64)]
    assert len(set(zip(mine, label))) == len(set(mine)) == len(set(label))


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1000)).all()


# --- suffixes ---


def plain_removal(docs, n=50):
    """docs: (id, bytes) pairs."""
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, b in docs:
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s not in least or key(i) < least[s]:
                least[s] = key(i)
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < key(i):
                gone[p : p + n] = True
        out.append(gone)
    return out


def passages(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij é"
    piece = lambda: "".join(rng.choices(letters, k=rng.randint(1, 160)))
    pool = [piece() for _ in range(12)]
    pool += ["xyz" * 60, "k" * 200]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else piece() for _ in range(rng.randint(0, 6))) for _ in range(40)]
    ids = [rng.choice([None, rng.randrange(60)]) if rng.random() < 0.1 else i for i in range(40)]
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_against_all_strings(spark, seed):
    data = passages(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup_report(df, chunk_bytes=1500, bucket_bytes=2000).collect()
    docs = [(i, t.encode()) for i, t in data]
    want = []
    for (i, b), gone in zip(docs, plain_removal(docs)):
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        want.append((str(i), len(b), int(gone.sum()), spans, kept))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_trees_of_frequent_passages(spark, seed):
    """Anchors that more than two chunks have go through trees of several levels."""
    data = passages(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup_report(df, chunk_bytes=250, bucket_bytes=2000, fan=2).collect()
    docs = [(i, t.encode()) for i, t in data]
    want = sorted((str(i), len(b), int(gone.sum())) for (i, b), gone in zip(docs, plain_removal(docs)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == want


def test_suffix_dedup_busiest_task_does_not_grow(spark):
    """One passage in every document: four times the chunks, the same largest number of rows in one place and level."""
    rng, fan = random.Random(5), 4
    passage = "".join(rng.choices("abcdefghijklmnop", k=120))

    def busiest(n):
        texts = [(i, passage + "".join(rng.choices("qrstuvwxyz", k=300))) for i in range(n)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
        chunks = suffix_dedup.pack_chunks(docs, "doc_id", "text", 400)
        shared = suffix_dedup.shared_hashes(chunks, 16, fan)
        depth = suffix_dedup.tree_depth(chunks.count(), fan)
        found = suffix_dedup.chunk_copies(chunks, shared, 16, fan ** (depth - 1))
        widest = found.filter("strings IS NOT NULL").groupBy("bucket").count().agg({"count": "max"}).first()[0]
        copies = suffix_dedup.bucket_copies(found, 16, fan, depth)
        assert copies.select("chunk").distinct().count() == n - 1
        return widest

    few, many = busiest(60), busiest(240)
    assert many <= 2 * max(few, fan) and many < 30


@pytest.mark.parametrize("chunk_bytes", [50, 64, 300])
def test_suffix_dedup_cuts_long_texts(spark, chunk_bytes):
    """Passages over the cuts, pieces shorter than a passage, a text that repeats itself, null and repeated ids."""
    rng = random.Random(chunk_bytes)
    a, b = ("".join(rng.choices("abcdefg", k=n)) for n in (700, 160))
    data = [(5, a), (1, b + "x"), (7, "q" * 33 + b + a[100:420] + b), (None, a[50:] + b), (None, a[:99]), (7, a), (3, "zz" * 130), (4, "z" * 99), (8, "s" * 50), (9, a[651:])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    docs = [(i, t.encode()) for i, t in data]
    want, left = [], []
    for (i, t), gone in zip(docs, plain_removal(docs)):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((str(i), len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
        left.append((str(i), kept))
    got = suffix_dedup.dedup_report(df, chunk_bytes=chunk_bytes, bucket_bytes=500).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    texts = suffix_dedup.remove_copies(df, chunk_bytes=chunk_bytes, bucket_bytes=500).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in texts) == sorted(left)


def test_suffix_dedup_edges(spark):
    got = suffix_dedup.dedup_report(table(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_bytes == 0 and by[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    twice = [r for r in got if r.doc_id == rows()[12][0]]
    assert len({r.n_removed for r in twice}) == 1  # repeated rows do not remove each other
    assert suffix_dedup.dedup_report(empty(spark)).count() == 0
    texts = {r.doc_id: bytes(r.data) for r in suffix_dedup.remove_copies(table(spark)).collect()}
    assert all(len(texts[i]) == by[i].n_bytes - by[i].n_removed for i in texts if i is not None)
