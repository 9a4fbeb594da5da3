import pytest

from foliospark import JobConfig, Upper, register_functions, run_folder
from foliospark.operators.chunk_text import chunk_text
from foliospark.sources.paths import load_ignore_lines


@pytest.fixture
def tree(tmp_path):
    base = tmp_path / "in"
    for rel, data in {
        "a.md": b"alpha\n", "d/b.md": b"beta\n" * 50, "d/c.txt": b"gamma\n", "skip/x.md": b"no\n",
        "bad.md": b"\xff\xfe", "empty.md": b"", "d/keep.log.md": b"kept\n", "_u.md": b"under\n", ".dot.md": b"dot\n",
        "_d/x.md": b"deep\n",
    }.items():
        (base / rel).parent.mkdir(parents=True, exist_ok=True)
        (base / rel).write_bytes(data)
    (base / ".gitignore").write_text("skip/\n*.log\n")
    (base / ".git").mkdir()
    return base


CFG = dict(data_format="text", chunk_size=20, sample_size=0)


def files(base):
    return {str(p.relative_to(base)): p.read_text() for p in base.rglob("*") if p.is_file()}


def test_mirror_then_skip_then_force(spark, tree, tmp_path):
    out = tmp_path / "out"
    r = run_folder(spark, str(tree), JobConfig(recurse="*.{md,py}", **CFG), Upper(), str(out))
    want = {
        "a.md": "ALPHA\n", "d/b.md": "BETA\n" * 50, "d/keep.log.md": "KEPT\n", "_u.md": "UNDER\n", ".dot.md": "DOT\n",
        "_d/x.md": "DEEP\n", "empty.md": "",
    }
    assert files(out) == want
    assert [u.path.rsplit("/", 1)[1] for u in r.unreadable.collect()] == ["bad.md"]
    summary = r.summary.first()
    assert (summary.successful, summary.failed) == (7, 1)
    assert [(f.path.rsplit("/", 1)[1], f.chunk_number) for f in r.failures.collect()] == [("bad.md", None)]
    assert r.metrics["calls"] == r.chunks.count() and r.metrics["failed_calls"] == 0
    (out / "a.md").write_text("stale")
    again = run_folder(spark, str(tree), JobConfig(recurse="*.md", **CFG), Upper(), str(out))
    assert again.written.count() == 0 and files(out)["a.md"] == "stale"
    run_folder(spark, str(tree), JobConfig(recurse="*.md", force=True, **CFG), Upper(), str(out))
    assert files(out) == want


def test_in_place_and_unrestricted(spark, tree):
    run_folder(spark, str(tree), JobConfig(recurse="*.md", unrestricted=True, **CFG), Upper())
    got = {str(p.relative_to(tree)): p.read_bytes() for p in tree.rglob("*.md")}
    assert got["skip/x.md"] == b"NO\n" and got["a.md"] == b"ALPHA\n"
    assert got["bad.md"] == b"\xff\xfe" and got["empty.md"] == b""


def test_dry_run_writes_nothing(spark, tree, tmp_path):
    r = run_folder(spark, str(tree), JobConfig(recurse="*.md", dry_run=True, **CFG), Upper(), str(tmp_path / "o"))
    assert r.report.first().total_chunks == r.chunks.count() and not (tmp_path / "o").exists()


def test_ignore_files_outermost_first(tmp_path):
    inner = tmp_path / "r" / "s"
    inner.mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("above\n")
    (tmp_path / "r" / ".git").mkdir()
    (tmp_path / "r" / ".gitignore").write_text("outer\n")
    (inner / ".gitignore").write_text("inner\n")
    assert load_ignore_lines(str(inner)) == ["outer", "inner"]


def test_sql_names(spark):
    register_functions(spark)
    row = spark.sql(
        r"SELECT token_count('abcdefgh') k, norm_newlines('a\r\nb\rc') n, tail_sample('abcdefgh', 1) t, completion_budget(1000, 80) c"
    ).first()
    assert tuple(row) == (3, "a\nb\nc", "efgh", 4500)
    assert spark.sql("SELECT piece FROM VALUES ('abcdefgh') AS v(x), LATERAL split_overlong(x, 2)").count() == 2


def test_sql_chunker_equals_the_chunker_without_a_shuffle(spark, capsys):
    texts = [None, "", "a\r\nb\rc\x85d\n\n", "x" * 2000 + "\ny\n" + "z" * 399, "line of text\n" * 5000, "\U0001f600" * 50 + "\u2028end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    register_functions(spark)
    docs.createOrReplaceTempView("sql_chunker_docs")
    for size in (5, 100):
        got = spark.sql(f"SELECT doc_id, chunk_index, chunk, chunk_tokens FROM sql_chunker_docs, LATERAL chunk_text(text, {size})")
        want = chunk_text(docs, size).select("doc_id", "chunk_index", "text", "token_count")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "posexplode" in plan and "Exchange" not in plan and "Join" not in plan


def test_relative_root(spark, tree, tmp_path, monkeypatch):
    from foliospark.sources.manifest import list_files

    monkeypatch.chdir(tree.parent)
    rels = {r.rel_path for r in list_files(spark, "in").collect()}
    assert rels == {str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file()}
    run_folder(spark, "in", JobConfig(recurse="a.md", **CFG), Upper(), str(tmp_path / "out"))
    assert files(tmp_path / "out") == {"a.md": "ALPHA\n"}


def test_header_without_text_stays(spark):
    from foliospark import Constant, run_job

    docs = spark.createDataFrame([(1, "---\ntitle: A\n---\n")], "doc_id long, text string")
    r = run_job(spark, docs, JobConfig(explain=True, **CFG), Constant("x"))
    assert "title: A" in r.documents.first().output_text


def test_many_small_files_are_read_by_many_tasks(spark, tmp_path):
    from foliospark.sources.documents import read_manifest

    rows = [(str(tmp_path / f"{i}"), 3) for i in range(5000)]
    got = read_manifest(spark.createDataFrame(rows, "path string, length bigint"))
    assert got.rdd.getNumPartitions() > 1


def test_bad_headers_cost_one_chunk_only(spark):
    from foliospark import Identity, run_job

    class Odd(Identity):
        def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
            text, _, model = super().__call__(messages, max_tokens, temp, top_p, chunk)
            return text, {"a.md": 7, "b": {"x-ratelimit-limit-tokens": None}, "c": {"x": object()}}[chunk[:1]] if chunk[:1] in "bc" else 7, model

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    r = run_job(spark, docs, JobConfig(**CFG), Odd())
    assert {x.doc_id: x.error is None for x in r.responses.collect()} == {1: False, 2: True, 3: True}


def test_links_to_folders_are_not_followed(spark, tmp_path):
    from foliospark.sources.manifest import list_files

    base = tmp_path / "in"
    (base / "a").mkdir(parents=True)
    (base / "a" / "one.md").write_text("one")
    (base / "a" / "loop").symlink_to(base / "a", target_is_directory=True)
    (base / "b.md").symlink_to(base / "a" / "one.md")
    assert sorted(r.rel_path for r in list_files(spark, str(base)).collect()) == ["a/one.md", "b.md"]


def test_small_files_are_passed_on_together(spark, tmp_path, monkeypatch):
    import pandas as pd

    from foliospark.sources import documents

    table = spark.createDataFrame([("x", 1)], "path string, length bigint")
    taken, real = [], type(table).mapInPandas
    monkeypatch.setattr(type(table), "mapInPandas", lambda self, run, schema: taken.append(run) or real(self, run, schema))
    documents.read_manifest(table)
    texts = [b"%d" % i for i in range(1_100)]
    texts[700] = b"x" * (documents.BATCH_BYTES + 1)
    rows = []
    for i, data in enumerate(texts):
        (tmp_path / str(i)).write_bytes(data)
        rows.append((str(tmp_path / str(i)), len(data)))
    rows.append((str(tmp_path / "none"), None))
    parts = list(taken[0](iter([pd.DataFrame(rows[:400]), pd.DataFrame(rows[400:])])))
    assert [len(p) for p in parts] == [500, 200, 1, 400]
    assert [bytes(c) for p in parts for c in p["content"]] == [*texts, b""]
    assert [p for part in parts for p in part["problem"] if p] != [] and parts[-1]["problem"].iloc[0] is None
