import time

from pyspark.sql import functions as F

from foliospark import JobConfig, create_chunks
from foliospark.plans.queries import QUERIES
from foliospark.streaming.ingest import drain, read_stream, start_deduplicated, start_parquet, stream_chunks
from foliospark.streaming.quota import stream_quota
from foliospark.streaming.state import track_documents

CFG = JobConfig(data_format="text", chunk_size=5)
SCHEMA = "doc_id bigint, text string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    for i in range(3):
        put(spark, tmp_path, [(i, "abcd\n" * (i + 4))])
    docs = read_stream(spark, str(tmp_path), SCHEMA, max_files=1)
    got = drain(stream_chunks(docs, CFG), "t").collect()
    want = create_chunks(spark.read.parquet(str(tmp_path)), CFG).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_state_spans_micro_batches(spark, tmp_path):
    """The same document arrives in two files; the second batch adds to the first."""
    put(spark, tmp_path, [(1, "aaaa\nbbbb\n")])
    put(spark, tmp_path, [(1, "aaaa\nbbbb\ncccc\n")])
    docs = read_stream(spark, str(tmp_path), SCHEMA, max_files=1)
    rows = drain(track_documents(stream_chunks(docs, CFG), 1, None), "s").collect()
    assert len(rows) == 2
    last = max(rows, key=lambda r: r.chunks)
    assert (last.chunks, last.tokens, last.last_index, last.last_text) == (3, 10, 1, "ccc\n")


def test_dedup_across_batches_and_restarts(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, src, [(1, "a"), (2, "b")])
    put(spark, src, [(2, "b"), (3, "c"), (3, "c")])
    for checkpoint in ("one", "one", "two"):
        docs = read_stream(spark, str(src), SCHEMA, max_files=1)
        q = start_deduplicated(docs, out, str(tmp_path / checkpoint))
        assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("doc_id", "text").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_quota_drops_late_rows_and_waits_for_the_watermark(spark, tmp_path):
    schema = "ts timestamp_ntz, tokens bigint"

    def log(*rows):
        df = spark.createDataFrame([(t, k) for t, k in rows], "t string, tokens bigint")
        df.select(F.col("t").cast("timestamp_ntz").alias("ts"), "tokens").coalesce(1).write.mode("append").parquet(str(tmp_path))

    log(("2024-01-01 00:00:10", 5), ("2024-01-01 00:00:50", 6))
    log(("2024-01-01 00:10:00", 1))
    q = drain(stream_quota(read_stream(spark, str(tmp_path), schema), "1 minute", "5 minutes", 10, 5), "q").collect()
    assert [(r.tokens, r.requests, r.tokens_over, r.requests_over) for r in q] == [(11, 2, True, False)]


def answers(spark, folder, *rows):
    df = spark.createDataFrame(rows, "part string, no int, chunk_index int, text string, token_count int, response string")
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return df.schema


def test_state_keeps_inputs_and_outputs_under_any_key(spark, tmp_path):
    """Two keys of different types, nulls among them; chunks without an answer are passed over; order of arrival is free."""
    schema = answers(spark, tmp_path, ("a", 1, 1, "bbbb", 2, "BBBB!"), ("a", 1, 0, "aaaa", 2, "AAAA"), (None, None, 0, "nnnn", 2, "N"))
    answers(spark, tmp_path, ("a", 1, 2, "cccc", 2, None), ("a", 2, 0, "dddd", 2, ""), (None, None, 1, "mmmm", 2, "MMMMMM"))
    docs = read_stream(spark, str(tmp_path), schema, max_files=1)
    rows = drain(track_documents(docs, 1, None, ["part", "no"], "response"), "s").collect()
    last = {(r.part, r.no): r for r in sorted(rows, key=lambda r: r.chunks)}
    short = {k: (r.chunks, r.tokens, r.last_index, r.last_text, r.output_tokens, r.last_output) for k, r in last.items()}
    assert short == {
        ("a", 1): (2, 4, 1, "bbbb", 4, "BBB!"), ("a", 2): (1, 2, 0, "dddd", 1, ""), (None, None): (2, 4, 1, "mmmm", 3, "MMMM"),
    }


def test_state_survives_a_restart_and_expires(spark, tmp_path):
    def run(hours, name):
        docs = read_stream(spark, str(tmp_path / "in"), SCHEMA, max_files=1)
        states = track_documents(stream_chunks(docs, CFG), 1, hours)
        q = start_parquet(states, name, str(tmp_path / f"{name}-out"), str(tmp_path / name), once=False)
        until = time.monotonic() + 60
        while sum(p.numInputRows for p in q.recentProgress) < 1 and time.monotonic() < until:
            time.sleep(0.2)
        q.stop()
        return [r.chunks for r in spark.read.parquet(str(tmp_path / f"{name}-out")).orderBy("chunks").collect()]

    put(spark, tmp_path / "in", [(1, "aaaa\nbbbb\n")])
    assert run(24, "kept") == run(1 / 3600, "brief") == [1]
    time.sleep(1.5)
    put(spark, tmp_path / "in", [(1, "cccc\n")])
    assert run(24, "kept") == [1, 2]
    assert run(1 / 3600, "brief") == [1, 1]


def test_a_table_that_is_a_folder_streams_like_one_that_is_a_file(spark, tmp_path):
    docs = [(i, f"text {i}\n") for i in range(30)]
    table = tmp_path / "folder" / "documents.parquet"
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(table))
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "one"))
    single = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(single.read_bytes())
    for sf in ("folder", "file"):
        got = QUERIES["stream_dedup_outputs"](spark, str(tmp_path / sf))
        assert sorted(map(tuple, got.collect())) == docs
        got = QUERIES["stream_chunks"](spark, str(tmp_path / sf)).select("doc_id", "text")
        assert sorted(map(tuple, got.collect())) == docs
