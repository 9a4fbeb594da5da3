"""Chunks of documents in many rows, against the chunks of the same documents in one."""

import random

import pytest

from foliospark import JobConfig, create_chunks
from foliospark.operators import chunk_code, chunk_structure, pack_lines
from foliospark.streaming.ingest import finished_keys


def documents(spark, seed=1):
    rng = random.Random(seed)
    texts = ["", "\n", "x" * 500, "a\r\nb\rc"] + ["".join("w" * rng.choice([0, 1, 5, 30, 39, 40, 41, 300]) + "\n" for _ in range(rng.randint(1, 90))) for _ in range(30)]
    return spark.createDataFrame(list(enumerate(texts)) + [(None, "no key\n" * 20)], "doc_id long, text string")


@pytest.mark.parametrize("block_lines", [1, 2, 7, 1000])
def test_equals_chunks_in_one_row(spark, block_lines):
    docs = documents(spark).filter("doc_id IS NOT NULL")
    want = create_chunks(docs, JobConfig(data_format="text", chunk_size=10)).select("doc_id", "chunk_index", "text", "token_count").collect()
    got = pack_lines.chunk_lines(pack_lines.document_lines(docs), 10, block_lines=block_lines).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_one_document_is_many_tasks(spark):
    docs = spark.createDataFrame([(1, "some line\n" * 5000)], "doc_id long, text string")
    lines = pack_lines.document_lines(docs).repartition(8).cache()
    chunks = pack_lines.chunk_lines(lines, 50, block_lines=100)
    assert chunks.count() == create_chunks(docs, JobConfig(data_format="text", chunk_size=50)).count()
    assert "hashpartitioning(doc_id" in (plan := chunks._jdf.queryExecution().toString()) and "block" in plan
    lines.unpersist()


def test_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, line_no long, line string")
    assert pack_lines.chunk_lines(nothing, 10).count() == 0


def test_line_scans_are_narrow(spark):
    docs = spark.createDataFrame([(1, "# a\n```\n# b\n```\n## c\n"), (2, "")], "doc_id long, text string")
    sections = chunk_structure.markdown_sections(docs)
    depths = chunk_code.code_depth(spark.createDataFrame([(1, "f( {\n}\n)\n}\n{")], "doc_id long, text string"))
    for df in (sections, depths):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert [(r.section_id, r.heading_level, r.title, r.n_lines) for r in sections.collect()] == [(1, 1, "a", 4), (2, 2, "c", 1)]
    assert [(r.line_no, r.brace_depth, r.paren_depth) for r in depths.collect()] == [(0, 1, 1), (1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 1, 0)]


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS doc_id", "CAST(pmod(xxhash64(id), 8) AS INT) AS bucket", "CAST(id % 3 AS BIGINT) AS batch")
    rows.write.partitionBy("bucket", "batch").parquet(str(tmp_path / "t"))
    batch = rows.filter("doc_id = 5")
    done = finished_keys(spark, str(tmp_path / "t"), "doc_id", "bigint", batch, 0)
    met = batch.first().bucket
    assert {r.doc_id for r in done.collect()} == {r.doc_id for r in rows.filter(f"bucket = {met} AND batch <> 0").collect()}
    assert "bucket#" in (plan := done._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: [" in plan and f"IN ({met})" in plan or f"= {met})" in plan
