"""MinHash components against a comparison of all pairs of full sets."""

import random

import numpy as np
import pytest
from edge_rows import empty, rows, table

from foliospark.llm import minhash

SF = "/root/testdata/sf0.001"


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_groups(ids, sets):
    """(id, size, component) per row, by comparing all pairs that share a shingle."""
    label, where = list(range(len(ids))), {}
    for i, s in enumerate(sets):
        for shingle in s:
            where.setdefault(shingle, []).append(i)
    near = {(i, j) for at in where.values() for i in at for j in at if i < j}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in near:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return sorted((str(x), len(s), str(least.get(find(i)) if s else x)) for i, (x, s) in enumerate(zip(ids, sets)))


def run(df):
    got = minhash.near_groups(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def test_awkward_rows(spark):
    data = rows()
    assert run(table(spark)) == plain_groups([r[0] for r in data], [plain_set(r[1]) for r in data])
    assert minhash.near_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    data = docs.select("doc_id", "text").collect()
    assert run(docs) == plain_groups([r.doc_id for r in data], [plain_set(r.text) for r in data])


def family(seed, n, words, most):
    """Variants of one text that are near some and not near others: chains, and stars whose centre is not linked."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        parent = list(rng.choice(out[-6:]))
        at = rng.randrange(words - most)
        parent[at : at + rng.randint(1, most)] = [f"n{rng.randrange(10**6)}"]
        out.append(parent)
    return [" ".join(x) for x in out]


def test_chains_and_wide_families_lose_no_link(spark):
    texts = [t for seed in range(4) for t in family(seed, 90, 120, 14)]
    random.Random(9).shuffle(texts)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{i}x{j}" for j in range(25)) for i in range(150)]  # similar to none, buckets shared by many
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = run(df)
    assert got == plain_groups(list(range(len(texts))), [plain_set(t) for t in texts])
    assert 100 < len({c for *_, c in got}) < len(texts)


def test_threshold_is_met_exactly(spark):
    def shingled(n, new):  # n distinct shingles, the last ``new`` of them its own
        return " ".join([f"a{i}" for i in range(n + 3 - new)] + [f"b{n}{i}" for i in range(new)])

    texts = [shingled(16, 0), shingled(20, 4), shingled(16, 0) + " z", shingled(10, 0), shingled(12, 2), shingled(8, 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df) == plain_groups(list(range(len(texts))), [plain_set(t) for t in texts])


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(4)
    for n in (5, 60, 800):
        hits = trials = 0
        for _ in range(60):
            both = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            extra = rng.integers(0, 2**64, max(1, n // 4), dtype=np.uint64)
            a, b = both, np.unique(np.concatenate((both, extra)))
            hits += int((minhash.signature(a) == minhash.signature(b)).sum())
            trials += minhash.BINS
        assert abs(hits / trials - n / (n + max(1, n // 4))) < 0.03


def test_set_of_pieces_equals_set_of_whole(monkeypatch):
    data = " ".join(f"Wörd{i % 977}" for i in range(20_000)).encode()
    whole = minhash.shingle_set(data)
    monkeypatch.setattr(minhash, "PIECE_BYTES", 1000)
    assert (minhash.shingle_set(data) == whole).all() and len(whole) == 977
    assert len(minhash.shingle_set(b"")) == len(minhash.shingle_set(b" \n")) == 0


def test_buckets_do_not_emit_pairs(spark):
    nodes = spark.createDataFrame([(i, 10, [7]) for i in range(500)], "node long, n long, keys array<long>")
    members = minhash.shared_buckets(nodes)
    assert members.count() == 500 and {r.centre for r in members.collect()} == {0}
