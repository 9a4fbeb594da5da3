import datetime
import json

import pytest
from pyspark.sql import functions as F

from foliospark import Constant, Identity, JobConfig, ModelSpec, Responder, Scripted, Upper, run_job
from foliospark.config import ApiError
from foliospark.functions import budget, metadata
from foliospark.operators import requests as rq
from foliospark.operators.reassemble import reassemble
from foliospark.operators.responders import is_retryable, respond
from foliospark.operators.transform import diagnostics, transform_chunks


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize("tokens,ratio,want", [(10, 100, 4096), (1000, 80, 4500), (100000, 100, 40000), (0, 1, 4096)])
def test_completion_budget(spark, tokens, ratio, want):
    assert one(spark, budget.completion_budget("t", ratio), t=tokens) == want


def test_completion_budget_rejects_negative(spark):
    with pytest.raises(Exception, match="non-negative"):
        one(spark, budget.completion_budget("t", 100), t=-1)


def test_fit_keeps_the_longest_halving_that_fits(spark):
    limit, tokens = 1000, lambda n: n // 4 + 1
    rows = [("ab" * n, b) for n in (0, 1, 39, 40, 200, 1000, 3001) for b in (0, 500, 900, 979, 980, 981, 999, 1000, 1200)]
    df = spark.createDataFrame(rows, "s string, b int")
    for r in df.select("s", "b", budget.fit_to_budget("s", "b", limit).alias("r")).collect():
        n, kept = len(r.s), len(r.r)
        assert r.s.startswith(r.r)
        assert kept == budget.shortened_length(n, limit - r.b)  # the same rule for rows and for columns
        lengths = [n >> k for k in range(n.bit_length() + 1)]
        assert kept == 0 or (kept in lengths and r.b + tokens(kept) <= limit)
        longer = [m for m in lengths if m > kept and r.b + tokens(m) <= limit]
        assert all(tokens(m) < 20 and m != n for m in longer)
        assert kept in (0, n) or tokens(kept) >= 20


FRONT = [
    ("---\ntitle: A\nauthor: B\n---\nbody\n", {"title": '"A"', "author": '"B"'}, "body"),
    ("no header", {}, "no header"),
    ("  padded \n", {}, "padded"),
    ("", {}, ""),
    ("---\ntitle: 'q: x'\nid: 7\ndate: 2024-01-05\nempty:\n---\n\nb", {"title": '"q: x"', "id": "7", "date": "2024-01-05", "empty": "null"}, "b"),
    ("---\ntags:\n  - a\n  - b\ntitle: T\n---\nx", {"tags": '["a","b"]', "title": '"T"'}, "x"),
    ("---\nbad: [1,\n---\nx", {}, "---\nbad: [1,\n---\nx"),
    ("---\nnever closed\n", {}, "---\nnever closed"),
    ("---\na: b\n---\n", {"a": '"b"'}, ""),
    ("---\nq: 'no'\nz: \"0\"\nd: yes\nf: 1.50\nh: 0x1F\nt: 2024-01-05 10:00:00\nw: 3 apples\n---\nb",
     {"q": '"no"', "z": '"0"', "d": "true", "f": "1.5", "h": "31", "t": '"2024-01-05 10:00:00"', "w": '"3 apples"'}, "b"),
]


def test_frontmatter(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FRONT)], "i int, text string")
    got = {r.i: (r.metadata, r.text) for r in metadata.with_frontmatter(df).collect()}
    assert got == {i: (m, b) for i, (_, m, b) in enumerate(FRONT)}
    ref = {r.i: r.text for r in metadata.with_frontmatter(df, "reference").collect()}
    assert ref[8] == FRONT[8][0]


def test_frontmatter_round_trip(spark):
    yaml = pytest.importorskip("yaml")
    meta = {"title": "It's: odd #1", "id": "007", "author": "Ann B", "date": "2024-01-05", "type": "yes", "note": "- x", "z": "null"}
    meta |= {"n": 7, "x": 2.5, "draft": True, "shut": False, "none": None, "tags": ["a", 1, {"k": "v"}], "lines": "a\nb", "digits": "0"}
    stored = {k: json.dumps(v) for k, v in meta.items()} | {"day": "2024-02-03"}
    text = one(spark, metadata.render_frontmatter(F.create_map(*[F.lit(x) for kv in stored.items() for x in kv]), F.lit("body")))
    head, body = text.split("---\n", 2)[1:]
    assert yaml.safe_load(head) == meta | {"day": datetime.date(2024, 2, 3)} and body == "\nbody"
    again = metadata.with_frontmatter(spark.createDataFrame([(text,)], "text string")).first()
    assert again.metadata.keys() == stored.keys() and again.metadata["day"] == "2024-02-03"
    assert {k: json.loads(v) for k, v in again.metadata.items() if k != "day"} == meta
    assert one(spark, metadata.render_frontmatter(F.create_map().cast("map<string,string>"), F.lit("b"))) == "---\n---\n\nb"


def test_missing_fields(spark):
    m = F.create_map(*[F.lit(x) for x in ("title", '"no"', "author", '""', "id", "0", "type", '"0"')])
    assert one(spark, metadata.missing_fields(m)) == ["author", "date", "id"]


def test_ascii_quirk(spark):
    m = F.create_map(F.lit("k"), F.lit('"é"'))
    assert one(spark, metadata.metadata_json(m, "reference")) == '{"k":"\\u00e9"}'
    assert one(spark, metadata.metadata_json(m)) == '{"k":"é"}'


def test_conversations_over_limit_are_never_collected(spark):
    rows = [(1, t, "user", "x" * 40) for t in range(5)] + [(2, t, "user", "y" * 40) for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in rq.conversation_requests(df, 100).collect()}
    assert len(got[1].messages) == 5 and got[1].error is None
    assert got[2].messages is None and got[2].over_limit and got[2].n_messages == 500


def chain(*entries):
    return [(r, ModelSpec(r.name, limit)) for r, limit in entries]


class Recording(Responder):
    def __init__(self, name, script):
        super().__init__(name)
        self.script, self.limits = list(script), []

    def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
        self.limits.append(max_tokens)
        step = self.script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step, {}, self.name


def ask(entries, retries=2):
    sleeps = []
    try:
        return respond(chain(*entries), [], 9000, 0, 1, "c", retries, sleeps.append), sleeps
    except ApiError as e:
        return str(e), sleeps


def test_fallback_order():
    p, f = Recording("p", [ApiError("429")]), Recording("f", ["ok"])
    assert ask([(p, 40000), (f, 2048)]) == (("ok", {}, "f"), []) and f.limits == [2048]
    p, f = Recording("p", ["", ApiError("quota"), "late"]), Recording("f", [""])
    assert ask([(p, 40000), (f, 2048)]) == (("late", {}, "p"), [1, 2])
    p = Recording("p", [ApiError("bad request")])
    assert ask([(p, 1)]) == ("bad request", [])
    p = Recording("p", [ApiError("server error")] * 3)
    assert ask([(p, 1)]) == ("no model of the chain answered: server error", [1, 2])


def test_retryable():
    assert is_retryable(Exception("Rate Limit hit")) and is_retryable(Exception("error code: 500"))
    assert not is_retryable(Exception("error code: 502"))


TEXT = JobConfig(data_format="text", chunk_size=5, sample_size=2, max_retry_attempts=0)
DOCS = [(1, "aaaa\nbbbb\ncccc\ndddd\neeee\nffff\n"), (2, ""), (3, "zzzz\n" * 4), (4, "kkkk\n" * 9)]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_job_totals_and_statuses(spark):
    fails = Scripted(fail_when=lambda c: "cccc" in c or "zzzz" in c, message="bad request")
    r = run_job(spark, docs(spark), TEXT, fails)
    got = {d.doc_id: (d.output_text, d.status) for d in r.documents.collect()}
    assert got == {
        1: ("aaaa\nbbbb\n[ERROR: Chunk 2 failed - bad request]eeee\nffff\n", "partial"),
        2: ("", "empty"),
        4: (DOCS[3][1], "ok"),
    }
    assert [q.doc_id for q in r.quarantine.collect()] == [3]
    s = r.summary.first()
    assert (s.successful, s.failed) == (3, 1)  # an empty document is a success
    assert r.failures.count() == 3
    assert r.report.first().total_chunks == r.chunks.count()
    d = r.diagnostics.first()
    assert d.temperature == 0.98 and d.rate_requests_remaining is None and not d.rate_headers_parsed


def test_dry_run_calls_nothing(spark):
    def boom(*a, **k):
        raise AssertionError

    r = run_job(spark, docs(spark), JobConfig(data_format="text", chunk_size=5, dry_run=True), boom)
    assert r.responses is None and r.report.first().estimated_calls == r.chunks.count()


def test_continuity_carries_only_successes(spark):
    # Classes of a test module are not importable in workers: define them here.
    class Echo(Responder):
        def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
            return messages[-1]["content"], {"x-ratelimit-remaining-tokens-minute": "7"}, "echo"

    class Flaky(Responder):
        def __call__(self, messages, *a, **k):
            if "cccc" in k["chunk"]:
                raise ApiError("bad")
            return k["chunk"].upper(), {}, "m"

    from foliospark import create_chunks

    chunks = create_chunks(docs(spark), TEXT)
    out = transform_chunks(chunks, TEXT, Flaky())
    replay = rq.replay_continuity(rq.attach_responses(chunks, out), TEXT)
    rebuilt = rq.build_requests(rq.prepare_requests(replay, TEXT), TEXT, "continuity")
    both = rebuilt.join(out.select("doc_id", "chunk_index", F.col("total_input_tokens").alias("sent")), ["doc_id", "chunk_index"])
    assert both.filter("sent <> total_input_tokens").count() == 0
    third = replay.filter("doc_id = 1 AND chunk_index = 2").first().continuity
    assert "aa\nbbbb\n"[-8:] in third and "BBBB" in third and "cccc" not in third
    assert replay.filter("chunk_index = 0 AND continuity <> ''").count() == 0
    heads = diagnostics(transform_chunks(chunks, TEXT, Echo())).first()
    assert heads.rate_tokens_remaining == 7 and heads.rate_headers_parsed


def test_no_continuity_means_no_shuffle(spark):
    from foliospark import create_chunks

    cfg = JobConfig(data_format="text", chunk_size=5, sample_size=0)
    flat = transform_chunks(create_chunks(docs(spark), cfg), cfg, Identity())
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()


def test_reassemble_many_chunks(spark):
    rows = [(1, i, 1000, f"{i},", None) for i in range(1000)] + [(2, i, 3, str(i), None) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, n_chunks int, response string, error string").repartition(8)
    got = {r.doc_id: (r.output_text, r.n_chunks) for r in reassemble(df).collect()}
    assert got == {1: ("".join(f"{i}," for i in range(1000)), 1000), 2: ("012", 3)}


def test_explain_completes_and_renders(spark):
    rows = [(1, "---\ntitle: A\n---\nbody one"), (2, "---\ntitle: A\nauthor: B\nid: C\ntype: D\ndate: E\n---\nbody two"), (3, "plain")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    filled = {"title": "GT", "author": "GA", "id": "GI", "type": "GY", "date": "GD"}

    class Both(Responder):
        def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
            return (json.dumps(filled) if chunk is None else chunk), {}, "m"

    r = run_job(spark, df, JobConfig(data_format="text", chunk_size=100, explain=True), Both())
    got = {d.doc_id: d.output_text for d in r.documents.collect()}
    head = "---\nauthor: GA\ndate: GD\nid: GI\ntitle: GT\ntype: GY\n---\n\n"
    assert got == {1: head + "body one", 2: "---\nauthor: B\ndate: E\nid: C\ntitle: A\ntype: D\n---\n\nbody two", 3: head + "plain"}
    bad = run_job(spark, df, JobConfig(data_format="text", chunk_size=100, explain=True), Constant("not json"))
    assert bad.chunks.filter("doc_id = 1").first().metadata == {"title": '"A"'}


def test_upper(spark):
    r = run_job(spark, docs(spark), TEXT, Upper())
    assert {d.doc_id: d.output_text for d in r.documents.collect()} == {i: t.upper() for i, t in DOCS}
