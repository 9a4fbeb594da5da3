"""Runs that are started again, and runs that wait for their quota."""

import sys
import threading
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark import JobConfig, run_folder, run_job
from foliospark.config import ApiError, ConfigError
from foliospark.functions import rates
from foliospark.operators.pacer import Pacer
from foliospark.operators.responders import Responder
from foliospark.operators.transform import transform_chunks
from foliospark.plans.job import run_job as job
from foliospark.sources import answer_log

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONFIG = JobConfig(data_format="text", chunk_size=5, sample_size=2, workers=2)


class Counting(Responder):
    """Leaves one file per call; raises where told to, as an error of the chunk or one that ends the task."""

    def __init__(self, folder, fail=None, die=None):
        super().__init__("m")
        self.folder, self.fail, self.die = str(folder), fail, die

    def reply(self, chunk):
        import os
        import uuid

        if self.die and self.die in chunk:
            raise SystemExit("lost")
        os.makedirs(self.folder, exist_ok=True)
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if self.fail and self.fail in chunk:
            raise ApiError("refused")
        return chunk.upper()


def calls(folder):
    return len(list(folder.iterdir())) if folder.exists() else 0


def documents(spark, n=40):
    rows = [(i, "".join(f"doc {i} line {j}\n" for j in range(i % 5 + 1))) for i in range(n)] + [(n, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(result):
    return {r.doc_id: r.output_text for r in result.documents.collect()}


def test_second_run_asks_only_for_the_rest(spark, tmp_path):
    docs, log = documents(spark), str(tmp_path / "log")
    first = run_job(spark, docs, CONFIG, Counting(tmp_path / "one", fail="doc 7 line 1"), log_dir=log)
    assert calls(tmp_path / "one") == first.chunks.count() == first.metrics["calls"] and first.metrics["failed_calls"] == 1
    assert [r.doc_id for r in first.failures.collect()] == [7] and "[ERROR: Chunk" in texts(first)[7]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "new words\n").otherwise(F.col("text")))
    second = run_job(spark, changed, CONFIG, Counting(tmp_path / "two"), log_dir=log)
    again = first.chunks.filter("doc_id = 7").count() + 1
    assert calls(tmp_path / "two") == again == second.metrics["calls"]
    assert texts(second) == {r.doc_id: r.text.upper() for r in changed.collect()} and second.failures.count() == 0
    third = run_job(spark, changed, CONFIG, Counting(tmp_path / "three"), log_dir=log)
    assert calls(tmp_path / "three") == 0 and texts(third) == texts(second)
    other = JobConfig(**{**vars(CONFIG), "temp": 0.1})
    run_job(spark, docs.limit(3), other, Counting(tmp_path / "four"), log_dir=log)
    assert calls(tmp_path / "four") > 0


def test_lost_run_leaves_its_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answer_log, "LOG_ROWS", 1)
    docs, log = documents(spark), str(tmp_path / "log")
    with pytest.raises(Exception):
        job(spark, docs, CONFIG, Counting(tmp_path / "one", die="doc 30 line 0"), log_dir=log)
    paid = calls(tmp_path / "one")
    result = job(spark, docs, CONFIG, Counting(tmp_path / "two"), log_dir=log)
    assert texts(result) == {r.doc_id: r.text.upper() for r in docs.collect()}
    total = result.chunks.count()
    assert paid > 0 and calls(tmp_path / "two") < total and paid + calls(tmp_path / "two") <= total + 10


def test_log_takes_one_whole_attempt(spark):
    at = "2024-01-01 00:00:00"
    schema = "doc_id long, chunk_index int, n_chunks int, answered_at timestamp, error string, doc_hash long, run string, attempt string"
    rows = [(1, 0, 2, at, None, 5, "r", "a"), (1, 0, 2, at, None, 5, "r", "b"), (1, 1, 2, at, "x", 5, "r", "b"), (1, 0, 2, at, None, 5, "r", "c"),
            (1, 1, 2, at, None, 5, "r", "c"), (2, 0, 2, at, None, 6, "r", "a"), (3, 0, 1, at, None, 7, "q", "a")]
    table = spark.createDataFrame([], schema).sparkSession.createDataFrame(
        [(a, b, c, None, e, f, g, h) for a, b, c, _, e, f, g, h in rows], schema).withColumn("answered_at", F.lit(at).cast("timestamp"))
    assert [tuple(r) for r in answer_log.whole_documents(table, "doc_id", "r").collect()] == [(1, 5, "c", 0)]
    assert answer_log.whole_documents(table, "doc_id", "r", 24).count() == 0


def test_half_written_files_are_not_read(spark, tmp_path):
    (tmp_path / "_x.parquet").write_bytes(b"PAR1")
    schema = spark.createDataFrame([], "doc_id long").schema
    assert answer_log.read_answers(spark, str(tmp_path), schema).count() == 0
    assert answer_log.read_answers(spark, str(tmp_path / "none"), schema).count() == 0


def test_folder_in_waves(spark, tmp_path):
    base, out = tmp_path / "in", tmp_path / "out"
    base.mkdir()
    for i in range(12):
        (base / f"{i}.md").write_text(f"text {i}\n" * (i % 3 + 1))
    config = JobConfig(data_format="text", chunk_size=5, sample_size=0, recurse="*.md")
    with pytest.raises(ConfigError):
        run_folder(spark, str(base), config, Counting(tmp_path / "c"), log_dir=str(tmp_path / "log"))
    with pytest.raises(Exception):
        run_folder(spark, str(base), config, Counting(tmp_path / "c", die="text 5"), str(out), log_dir=str(tmp_path / "log"), waves=4)
    early = {p.name for p in out.glob("*.md")} if out.exists() else set()
    result = run_folder(spark, str(base), config, Counting(tmp_path / "c"), str(out), log_dir=str(tmp_path / "log"), waves=4)
    assert {p.name: p.read_text() for p in out.glob("*.md")} == {p.name: p.read_text().upper() for p in base.glob("*.md")}
    assert result.written.count() == 12 - len(early) and result.written.filter("error IS NOT NULL").count() == 0


# --- pacing ---


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


class Quota(Responder):
    """A service with so many tokens a minute, that counts on its own clock and refuses what is over."""

    def __init__(self, clock, limit):
        super().__init__("m")
        self.clock, self.limit, self.left, self.start = clock, limit, limit, clock()

    def __call__(self, messages, max_tokens, temp, top_p, chunk=None):
        if self.clock() >= self.start + 60:
            self.start, self.left = self.clock(), self.limit
        self.left -= sum(len(m["content"]) // 4 + 1 for m in messages)
        if self.left < 0:
            raise ApiError("over the quota, refused")
        headers = {rates.H_LIMIT_TOKENS: self.limit, rates.H_LEFT_TOKENS: self.left, rates.H_RESET_TOKENS: self.start + 60 - self.clock(), rates.H_LEFT_REQUESTS: 900}
        return chunk, headers, "m"


def test_paced_run_never_exceeds_the_quota(spark):
    docs = spark.createDataFrame([(1, "some words here\n" * 120)], "doc_id long, text string")
    chunks = job(spark, docs, JobConfig(data_format="text", chunk_size=50)).chunks

    def answers(pacing):
        clock = Clock()
        config = JobConfig(data_format="text", chunk_size=50, sample_size=0, workers=1, max_retry_attempts=0, pacing=pacing)
        return transform_chunks(chunks, config, Quota(clock, 200), clock=clock, sleep=clock.sleep).collect()

    assert all(r.error is None for r in answers("headers"))
    assert any(r.error is not None for r in answers("off"))


def test_pacer_follows_the_rules():
    def pacer(tasks=1, **headers):
        clock = Clock()
        p = Pacer(tasks, clock, clock.sleep)
        names = {"limit": rates.H_LIMIT_TOKENS, "left": rates.H_LEFT_TOKENS, "requests": rates.H_LEFT_REQUESTS, "reset": rates.H_RESET_TOKENS}
        p.answered({names[k]: v for k, v in headers.items()})
        return p

    assert pacer().delay(10) == rates.MIN_DELAY and pacer(left="many").delay(10) == rates.MIN_DELAY
    assert pacer(left="5", reset="30").delay(10) == 30 and pacer(left="5", reset="300").delay(10) == 60
    assert pacer(left="5", reset="soon").delay(10) == 60
    assert pacer(left="20000", reset="50").delay(10) == 5 and pacer(left="20000", reset="3").delay(10) == 1
    assert pacer(left="90000", limit="60000", requests="500").delay(1600) == 1 and pacer(left="90000", limit="60000").delay(10**4) == 2
    assert pacer(left="90000", requests="7").delay(10) == rates.LOW_QUOTA_DELAY and pacer(left="90000", requests="500").delay(10) == rates.MIN_DELAY
    shared = pacer(4, left="80", reset="30")
    assert shared.delay(21) == 30 and shared.delay(20) < 30
    fresh = Pacer(1, Clock(), lambda s: pytest.fail("the first call waits for nothing"))
    fresh.before(10)


class Waiting(Responder):
    """Answers one document only when told to."""

    def __init__(self, flag):
        super().__init__("m")
        self.flag = str(flag)

    def reply(self, chunk):
        import os
        import time

        until = time.monotonic() + 120
        while "doc 4 " in chunk and not os.path.exists(self.flag) and time.monotonic() < until:
            time.sleep(0.1)
        return chunk


def test_progress_is_seen_before_the_end(spark, tmp_path):
    docs, log = documents(spark, 12), str(tmp_path / "log")
    assert answer_log.run_progress(spark, log).count() == 0
    result = []
    thread = threading.Thread(target=lambda: result.append(run_job(spark, docs, CONFIG, Waiting(tmp_path / "go"), log_dir=log)))
    thread.start()
    try:
        until, seen = time.monotonic() + 60, 0
        while not seen and time.monotonic() < until and thread.is_alive():
            time.sleep(0.5)
            seen = sum(r.answers for r in answer_log.run_progress(spark, log).collect())
        assert thread.is_alive() and seen > 0
    finally:
        (tmp_path / "go").write_text("")
        thread.join(120)
    done = answer_log.run_progress(spark, log).first()
    assert done.answers == result[0].chunks.count() > seen and done.failed_answers == 0 and done.documents == 12


def test_fast_answers_fill_few_files(tmp_path):
    """A file follows 200 answers or 30 seconds, and later on a sixteenth of what its task has logged."""
    writer = answer_log.AnswerWriter(str(tmp_path), pa.schema([("n", pa.int64()), ("attempt", pa.string())]))
    held, logged = [], 0
    for n in range(100_000):
        held.append(n)
        if writer.is_due(len(held)):
            assert len(held) <= max(200, logged / 16 + 1)
            writer.write(pd.DataFrame({"n": held}))
            held, logged = [], n + 1
    assert logged > 90_000 and len(list(tmp_path.iterdir())) < 100
    assert sorted(parquet.read_table(str(tmp_path)).column("n").to_pylist()) == list(range(logged))
    writer.due = 0
    assert writer.is_due(1) and not writer.is_due(0)
