"""Fill-in-the-middle against a plain tokenizer, and the learned index against the offsets it must return."""

import hashlib
import random
import re

import numpy as np
import pytest
from edge_rows import empty, rows, table
from pyspark.sql import functions as F

from foliospark.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (str(doc_id), len(tokens), form, *sizes, out)


def test_samples_and_restoration(spark):
    tail = (None,) * (len(rows()[0]) - 2)
    marked = [(1000 + i, t, *tail) for i, t in enumerate(["a <P> b", "x<S>y", "<M>", "<P", "a < S> <", "<<", "  lead and tail \n"] * 6)]
    data = rows() + marked
    got = fim.fill_in_middle(table(spark, data)).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    got = got.select("row.*", *(F.col(c).alias(f"fim_{c}") for c in ("n", "form", "prefix_chars", "middle_chars", "output", "restored"))).collect()
    mine = [(str(r.doc_id), r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) for r in got]
    assert sorted(map(repr, mine)) == sorted(repr(plain(r[0], r[1])) for r in data)
    assert {r.fim_form for r in got} == {"plain", "spm", "psm"}
    assert all(r.fim_restored == (r.text or "") for r in got)


def test_digests_agree_with_samples(spark):
    got = {(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in fim.digests(table(spark)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(*w[:5], sha(w[5])) for w in (plain(r[0], r[1]) for r in rows())}


def test_empty_table(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0 and fim.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("error", [0, 1, 7, 100, 126])
def test_index_is_exact_and_bounded(error):
    rng = random.Random(error)
    for steps in ([1] * 5000, [rng.randint(1, 12) for _ in range(20_000)], [rng.choice([1, 2, 5000]) for _ in range(900)], [10**7, 1, 1], []):
        offsets = np.concatenate(([0], np.cumsum(np.array(steps, np.int64)))).astype(np.int64)
        index = fim.RankIndex(offsets, error)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residual.astype(int)).max() <= error + 1
    assert len(fim.RankIndex(np.arange(0, 70_000, 7), error).first) == 1  # a straight line is one piece


def test_index_refuses_wide_residuals():
    with pytest.raises(ValueError):
        fim.RankIndex(np.arange(3), 127)


def test_boundaries_equal_the_pattern():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(" \t\n\x0b\x0c\rabé日🎉\x00\x1c\x85\xa0") for _ in range(rng.randint(0, 30)))
        ends = [0, *(len(text[: m.end()].encode()) for m in TOKEN.finditer(text))]
        assert fim.boundaries(text.encode()).tolist() == ends


def test_very_long_text():
    data = ("wörd " * 2_000_000).encode()
    n, prefix, middle = fim.cut(data, 1_500_000, 500_000)
    assert (n, prefix, middle) == (2_000_001, 2_499_999, 5_000_000)
