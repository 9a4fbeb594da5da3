import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from models import code_chunks, text_chunks, tok, xml_chunks, xml_normal, xml_spans

from foliospark import JobConfig, create_chunks, register_strategy
from foliospark.config import ChunkingError, ConfigError
from foliospark.functions import xml


def run(spark, texts, **config):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = create_chunks(df, JobConfig(**config)).collect()
    got = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        assert r.chunk_index == len(got[r.doc_id])
        got[r.doc_id].append((r.text, r.token_count))
    for r in rows:
        assert r.n_chunks == len(got[r.doc_id])
    return got


def prose(rnd, n):
    ends = ["\n", "\r\n", "\r", "\n\n", "\x0b", "\x1c", "\x85", "\u2028", "", " ", ". "]
    return "".join(
        "".join(rnd.choice("abcé ßñ😀") for _ in range(rnd.choice([0, 3, 9, 30, 120]))) + rnd.choice(ends)
        for _ in range(n)
    )


TEXTS = ["", "\n", "x", "Line 1\n" * 100, "word " * 88, "a\r\nb\rc", "\uffffa\nb", "😀" * 200, "é😀" * 100 + "\n" + "y" * 79]


@pytest.mark.parametrize("cs", [1, 2, 20, 100])
def test_text_matches_model(spark, cs):
    rnd = random.Random(cs)
    texts = TEXTS + [prose(rnd, rnd.randint(1, 60)) for _ in range(120)]
    assert run(spark, texts, data_format="text", chunk_size=cs) == [text_chunks(t, cs) for t in texts]


@pytest.mark.parametrize("cs", [260, 2000])
def test_wide_windows(spark, cs):
    texts = ["é" * 40_000, "a😀" * 9_000, "b" * (4 * cs - 1), "b" * (4 * cs), "\n".join(["c" * 9_001] * 3)]
    assert run(spark, texts, data_format="text", chunk_size=cs) == [text_chunks(t, cs) for t in texts]


def test_many_chunks_in_one_document(spark):
    text = "abcdefg\n" * 60_000
    got = run(spark, [text], data_format="text", chunk_size=3)[0]
    assert got == [("abcdefg\n", 3)] * 60_000


def test_text_is_lossless_and_bounded(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, 50) for _ in range(50)]
    for t, got in zip(texts, run(spark, texts, data_format="text", chunk_size=10)):
        assert "".join(s for s, _ in got) == t.replace("\r\n", "\n").replace("\r", "\n")
        assert all(k <= 10 for _, k in got)


def code(rnd, n):
    kinds = [
        "def f(a):\n", "  x = {1: 2}\n", "}\n", "{\n", "(\n", ")\n", 's = "open\n', "t = 'a{' + \"b\"\n", "\n", "  def g():\n",
        "from a import b\n", "import os\n", "y" * 30 + "\n", "z" * 200 + "\n", "# c\n", "/** doc\n", 'e = "\\"{"\n', "def \n",
    ]
    return "".join(rnd.choice(kinds if rnd.random() < 0.5 else kinds[12:13] + kinds[1:3]) for _ in range(n))


@pytest.mark.parametrize("cs", [5, 20, 60])
@pytest.mark.parametrize("quirks", ["fixed", "reference"])
def test_code_matches_model(spark, cs, quirks):
    rnd = random.Random(cs)
    texts = ["", "x"] + [code(rnd, rnd.randint(1, 90)) for _ in range(150)]
    want = [code_chunks(t, cs, quirks == "reference") for t in texts]
    assert run(spark, texts, data_format="code", chunk_size=cs, quirks=quirks) == want


def markup(rnd, n):
    kinds = ["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "text & more ", " ", "<!-- c -->", "<![CDATA[ <z> ]]>", "<?pi?>", "<!-->", "<!DOCTYPE x>", "q\n"]
    return "".join(rnd.choice(kinds) for _ in range(n)) + rnd.choice(["", "", "<open", "<!-- never"])


def markups():
    rnd = random.Random(1)
    fixed = ["", "plain", "<r><a/>t</r>", "Hello <b>welcome</b>", "<a>1</a><a>2</a>" * 30, "<p>x</p>" + "y" * 200, "  <a/>  "]
    return fixed + [markup(rnd, rnd.randint(1, 40)) for _ in range(300)] + ["".join(f"<i>{n}</i>\n" for n in range(60))]


def test_xml_scanners_match_model():
    for x in markups():
        assert xml.normalize(x) == xml_normal(x)
        assert xml.spans(x) == xml_spans(x)


@pytest.mark.parametrize("cs", [4, 15, 100])
def test_xml_matches_model(spark, cs):
    texts = markups()
    assert run(spark, texts, data_format="xml", chunk_size=cs) == [xml_chunks(t, cs) for t in texts]


@settings(max_examples=200, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.text(alphabet="<>/!-[]?CDAT& ab'\"", max_size=40))
def test_xml_scanners_property(x):
    assert xml.normalize(x) == xml_normal(x)
    assert xml.spans(x) == xml_spans(x)


def squeeze(s):
    return "".join(s.split())


@pytest.mark.parametrize("fmt", ["semantic", "markdown"])
@pytest.mark.parametrize("cs", [3, 10, 60])
def test_structure_keeps_text_and_size(spark, fmt, cs):
    rnd = random.Random(cs)
    texts = TEXTS[:5] + [prose(rnd, 60).replace("\r", "\n") for _ in range(60)]
    for t, got in zip(texts, run(spark, texts, data_format=fmt, chunk_size=cs)):
        assert squeeze("".join(s for s, _ in got)) == squeeze(t)
        assert all(len(s) <= 4 * cs and k == tok(s) and s for s, k in got)


def test_semantic_prefers_paragraphs_then_sentences(spark):
    text = "One two. Three four.\n\nFive six. Seven eight.\nNine ten."
    assert [s for s, _ in run(spark, [text], data_format="semantic", chunk_size=9)[0]] == [
        "One two. Three four.", "Five six. Seven eight.\nNine ten.",
    ]
    assert [s for s, _ in run(spark, ["One two. Three four."], data_format="semantic", chunk_size=3)[0]] == [
        "One two.", "Three four.",
    ]


def test_markdown_starts_chunks_at_headings(spark):
    text = "# A\n\npara one\n\n## B\n\npara two is here\n\n# C\n\nend\n"
    got = [s for s, _ in run(spark, [text], data_format="markdown", chunk_size=10)[0]]
    assert got == ["# A\n\npara one\n\n## B\n\npara two is here", "# C\n\nend"]


def test_markdown_keeps_a_fence_together(spark):
    fence = "```\n# not a heading\n\ncode\n```\n"
    got = [s for s, _ in run(spark, ["intro text here\n\n" + fence + "\nafter\n"], data_format="markdown", chunk_size=9)[0]]
    assert any(fence.strip() in s for s in got)


def test_line_splitter_equals_text(spark):
    texts = [prose(random.Random(2), 40)]
    want = run(spark, texts, data_format="text", chunk_size=20)
    for fmt in ("semantic", "markdown"):
        assert run(spark, texts, data_format=fmt, chunk_size=20, splitter="lines") == want


def test_custom_strategy_and_errors(spark):
    register_strategy("half", lambda d, c: create_chunks(d, JobConfig(data_format="text", chunk_size=max(1, c.chunk_size // 2))))
    assert run(spark, ["Line 1\n" * 20], data_format="half", chunk_size=20) == run(spark, ["Line 1\n" * 20], data_format="text", chunk_size=10)
    with pytest.raises(ChunkingError):
        run(spark, ["x"], data_format="nope")
    for bad in ({"chunk_size": 0}, {"chunk_size": 131_001}, {"sample_size": -1}, {"max_tokens_ratio": 0}, {"temp": 3}, {"workers": 0}):
        with pytest.raises(ConfigError):
            JobConfig(**bad)


def test_chunking_evaluates_the_fold_once(spark):
    df = spark.createDataFrame([(1, "a\n" * 50)], "doc_id bigint, text string")
    for fmt in ("text", "code", "semantic", "markdown"):
        chunks = create_chunks(df, JobConfig(data_format=fmt, chunk_size=4)).filter("n_chunks < 1000 AND token_count > 0")
        plan = chunks._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in plan
        assert plan.count("aggregate(") <= 4, fmt


def test_xml_udfs_hold_few_texts_at_a_time(spark):
    """A batch of thousands of long texts would fill a task's memory; so a batch is what Spark pickles, a hundred rows."""
    from pyspark.sql import functions as F

    from foliospark.functions.xml import xml_children, xml_normalize, xml_parts, xml_spans, xml_wrap

    rows = [(1, None), (2, ""), (3, "a & b"), (4, "<a><b/>t</a>")]
    d = spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id")
    got = d.select(xml_normalize("text").alias("n"), xml_spans("text").alias("s"), xml_parts("text", F.lit(1)).alias("p"), xml_wrap("text").alias("w"), xml_children("text").alias("c"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    none, empty, wrapped, formed = got.collect()
    assert (none.n, none.s, tuple(none.p), none.w, none.c) == (None, None, (None, None), None, None)
    assert (empty.n, empty.s, empty.w, empty.c) == ("<x></x>", [], "<x></x>", [])
    assert wrapped.n == wrapped.p.norm == "<p>a &amp; b</p>" and wrapped.p.elements == ["<p>a &amp; b</p>"]
    assert formed.n == formed.w == "<a><b/>t</a>" and [tuple(s) for s in formed.s] == [(0, 12)] and formed.c == ["<b/>", "t"]
