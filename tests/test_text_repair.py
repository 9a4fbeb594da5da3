"""Rules on texts and repeated lines."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.operators import text_repair as tr


@pytest.mark.parametrize("rule, text, want", [
    (tr.dehyphenate, "exam-\nple and well-\nKnown, 3-\n4", "example and well-\nKnown, 3-\n4"),
    (tr.clean_spacing, "a  \t b\n \n\n \nc\nd", "a b\n\nc\nd"),
    (tr.drop_page_numbers, "x\n 12 \nPage 3\n- 4 -\n12345\ny 7\n", "x\n12345\ny 7\n"),
    (tr.drop_garble, "a■□b ???? c??? \ufffdd", "ab  c??? d"),
    (tr.merge_lines, "a\nb\nc.\nd\n\ne\n1", "a b c.\nd\n\ne\n1"),
])
def test_rules(spark, rule, text, want):
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r.x for r in df.select(rule("t").alias("x")).collect()]
    assert got[0] == want and got[1] == ""


def test_repeated_lines_against_plain_counts(spark):
    lines = ["head", "foot", "", "  ", "rare", "x", "ünï"]
    data = [(i % 50, ["s", "t", None][i % 3], "\n".join(lines[(i * k + i // 3) % 7] for k in range(i % 9))) for i in range(90)]
    data += [(None, "s", "head\nhead\nown"), (7, "lonely", "head"), (8, "s", None)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    share, size = Counter(), Counter(s for _, s, _ in data)
    for _, s, t in data:
        share.update({(s, x) for x in (t or "").split("\n") if x.strip(" ")})
    common = {k for k, n in share.items() if n >= 4 and 100 * n >= 40 * size[k[0]]}
    assert common and len(common) < len(share)
    want = []
    for i, s, t in data:
        kept = None if t is None else [x for x in t.split("\n") if (s, x) not in common]
        want.append((i, s, t if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    got = tr.drop_repeated_lines(df, least_docs=4, percent=40).select("doc_id", "source", "text", "n_dropped")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert tr.drop_repeated_lines(df.filter("false")).count() == 0


def test_hot_line_is_spread(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat_ws("\n", F.lit("hot"), F.col("id").cast("string")).alias("text"))
    got = tr.drop_repeated_lines(df)
    assert got.filter("n_dropped = 1").count() == 2000 and got.filter("text = 'hot'").isEmpty()
