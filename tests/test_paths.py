import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from foliospark.sources import documents, manifest
from foliospark.sources.paths import expand_braces, ignore_rule, is_ignored

BRACES = [
    ("notes.{rst,adoc}", ["notes.rst", "notes.adoc"]),
    ("{a,b}-{1,2}.csv", ["a-1.csv", "a-2.csv", "b-1.csv", "b-2.csv"]),
    ("x{ left , right }y", ["xlefty", "xrighty"]),
    ("k{p,,q}", ["kp", "kq"]),
    ("one{only}", ["oneonly"]),
    ("plain/path", ["plain/path"]),
    ("open{a,b", ["open{a,b"]),
    ("shut}a,b{", ["shut}a,b{"]),
    ("none{}here", ["none{}here"]),
    ("{u,v}{}", ["u{}", "v{}"]),
]


@pytest.mark.parametrize("pattern,want", BRACES)
def test_braces(pattern, want):
    assert expand_braces(pattern) == want


def test_brace_column_agrees(spark):
    df = spark.createDataFrame([(p,) for p, _ in BRACES], "p string")
    got = df.select("p", manifest.expand_pattern("p").alias("e")).collect()
    assert {r.p: r.e for r in got} == dict(BRACES)


def test_two_groups():
    assert expand_braces("{a,b}/*.{x,y}") == ["a/*.x", "a/*.y", "b/*.x", "b/*.y"]


TREE = ["root.md", "root.txt", "a/x.md", "a/x.py", "a/b/y.md", "c/z.log", "c/.git/config.md", ".git/h.md", "a/b/k/deep.txt"]


def paths_table(spark, rels=TREE):
    rows = [("/in/" + r, r, 10 * i) for i, r in enumerate(rels)]
    return spark.createDataFrame(rows, "path string, rel_path string, length bigint")


def found(df):
    return sorted(r.rel_path for r in df.collect())


def test_discover(spark):
    t = paths_table(spark)
    assert found(manifest.discover(t, "*.md")) == ["a/b/y.md", "a/x.md", "root.md"]
    assert found(manifest.discover(t, "a/*.{md,py}")) == ["a/x.md", "a/x.py"]
    assert found(manifest.discover(t, "**/b/**/*.*")) == ["a/b/k/deep.txt", "a/b/y.md"]
    assert found(manifest.discover(t, "nothing.*")) == []
    assert found(manifest.discover(t, "[bad")) == []
    out = {r.rel_path: r.output_path for r in manifest.discover(t, "*.py", "/out").collect()}
    assert out == {"a/x.py": "/out/a/x.py"}
    assert [r.output_path for r in manifest.discover(t, "*.py").collect()] == ["/in/a/x.py"]


def test_list_files_reads_the_tree(spark, tmp_path):
    for rel in ("a.md", "d/b.md", "d/e/c.txt"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(rel)
    files = manifest.list_files(spark, str(tmp_path))
    assert found(files) == ["a.md", "d/b.md", "d/e/c.txt"]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert found(manifest.discover(files, "*.md")) == ["a.md", "d/b.md"]


IGNORE = [
    (["*.log"], ["a.log", "d/b.log"], ["a.txt"]),
    (["build/"], ["build/x", "d/build/x"], ["build", "builds/x"]),
    (["*.log", "!keep.log"], ["a.log"], ["keep.log", "d/keep.log"]),
    (["!keep.log", "*.log"], ["keep.log"], ["x"]),
    (["/top.txt"], ["top.txt"], ["d/top.txt"]),
    (["doc/*.txt"], ["doc/a.txt"], ["doc/s/a.txt", "x/doc/a.txt"]),
    (["**/tmp"], ["tmp", "a/tmp", "a/tmp/f"], ["tmpx"]),
    (["a/**/z"], ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]),
    (["logs/**"], ["logs/a", "logs/a/b"], ["logs"]),
    (["# note", "", r"\#odd", "f?.[ch]", "g[!0-9]"], ["#odd", "f1.c", "gx"], ["note", "f12.c", "g1"]),
]


@pytest.mark.parametrize("rules,ignored,kept", IGNORE)
def test_ignore_rules(spark, rules, ignored, kept):
    df = spark.createDataFrame([(p,) for p in ignored + kept], "p string")
    got = {r.p: r.i for r in df.select("p", is_ignored("p", rules).alias("i")).collect()}
    assert got == {**dict.fromkeys(ignored, True), **dict.fromkeys(kept, False)}


def test_ignore_run_merging_keeps_last_match(spark):
    rnd = random.Random(3)
    names = [f"{a}{b}" for a in "abc" for b in "123"]
    for _ in range(10):
        rules = [rnd.choice(["", "!"]) + rnd.choice(["a*", "*1", "b?", "c3", "*"]) for _ in range(6)]
        df = spark.createDataFrame([(n,) for n in names], "p string")
        got = {r.p: r.i for r in df.select("p", is_ignored("p", rules).alias("i")).collect()}
        want = {}
        for n in names:
            hits = [not r.startswith("!") for r in rules if fnmatch.fnmatchcase(n, r.lstrip("!"))]
            want[n] = bool(hits) and hits[-1]
        assert got == want, rules


def test_blank_rule():
    assert ignore_rule("") is None and ignore_rule("  ") is None and ignore_rule("/") is None


def test_prescreen(spark):
    pairs = spark.createDataFrame([("a", "oa"), ("b", "ob"), ("c", "oc"), ("d", "d")], "path string, output_path string")
    there = spark.createDataFrame([("oa",), ("oc",), ("d",)], "path string")
    assert sorted(r.path for r in manifest.prescreen(pairs, there).collect()) == ["b", "d"]
    assert manifest.prescreen(pairs, there, force=True).count() == 4


def test_pending_ignores_old_records(spark):
    items = spark.range(4).withColumnRenamed("id", "doc_id")
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    done = spark.createDataFrame(
        [(0, "2024-01-02 12:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "doc_id bigint, t string"
    ).select("doc_id", F.col("t").cast("timestamp").alias("completed_at"))
    assert sorted(r.doc_id for r in manifest.pending(items, done, now).collect()) == [1, 3]


def test_read_files_reports_bad_rows(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes("é\r\nb\rc".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in documents.read_files(spark, str(tmp_path), 50).collect()}
    assert got == {"ok.txt": ("é\nb\nc", None), "bad.txt": (None, "not valid UTF-8"), "big.txt": (None, "file too large")}


def test_write_files(spark, tmp_path):
    target = tmp_path / "out" / "a.txt"
    target.parent.mkdir()
    target.write_text("old")
    df = spark.createDataFrame([(str(target), "new é"), (str(tmp_path / "n" / "b.txt"), "")], "output_path string, output_text string")
    assert sorted(r.bytes for r in documents.write_files(df, backup=True).collect()) == [0, 6]
    assert target.read_text() == "new é" and target.with_name("a.txt.bak").read_text() == "old"
    assert sorted(p.name for p in target.parent.iterdir()) == ["a.txt", "a.txt.bak"]
