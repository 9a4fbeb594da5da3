"""A log of answers that outlives a failed run.

Every task writes what it has been answered so far as small Parquet files of its own, under a name of its attempt.  A file
takes its final name only when complete, so readers never see half of one.  Writing an answer twice (a lost executor, a
speculative copy) is harmless: a document's answers are taken from one attempt only, since each was sent with the one
before it.
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifest import rooted

#: A file is written after so many answers or seconds.
LOG_ROWS, LOG_SECONDS = 200, 30.0
#: A file waits for this part of the answers that its task has logged, so that fast answers do not fill a folder with files.
LOG_PART = 16


class AnswerWriter:
    """The files of one task attempt."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.folder, self.schema, self.attempt = folder, schema, uuid.uuid4().hex
        self.due, self.logged = time.monotonic() + LOG_SECONDS, 0

    def is_due(self, rows: int) -> bool:
        return rows >= max(LOG_ROWS, self.logged // LOG_PART) or (rows > 0 and time.monotonic() >= self.due)

    def write(self, answers: pd.DataFrame) -> None:
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        name = f"{self.attempt}-{uuid.uuid4().hex}.parquet"
        table = pa.Table.from_pandas(answers.assign(attempt=self.attempt), self.schema, preserve_index=False)
        with store.open_output_stream(f"{base}/_{name}") as out:  # readers pass over names that start so
            parquet.write_table(table, out)
        store.move(f"{base}/_{name}", f"{base}/{name}")
        self.due, self.logged = time.monotonic() + LOG_SECONDS, self.logged + len(answers)


def read_answers(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All logged answers; none if nothing was logged."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(rooted(folder))
    if store.get_file_info(base).type != fs.FileType.Directory or not any(
        i.type == fs.FileType.File and not i.base_name.startswith("_") for i in store.get_file_info(fs.FileSelector(base))
    ):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(rooted(folder))


def whole_documents(answers: DataFrame, key: str, run: str, max_age_hours: float | None = None) -> DataFrame:
    """(key, doc_hash, attempt, failed) of the documents whose every chunk one attempt of ``run`` has answered: the attempt
    with the fewest failed chunks, then the latest.  Older attempts than ``max_age_hours`` don't count."""
    age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("answered_at")) / F.lit(3_600_000_000.0)
    mine = answers.filter(F.col("run") == run)
    tries = mine.groupBy(key, "doc_hash", "attempt").agg(
        F.count("*").alias("n"), F.max("n_chunks").alias("n_chunks"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.max("answered_at").alias("answered_at"), F.max(age).alias("age"),
    ).filter("n = n_chunks")
    if max_age_hours is not None:
        tries = tries.filter(F.col("age") <= max_age_hours)
    best = F.max_by(F.struct("attempt", "failed"), F.struct(-F.col("failed"), "answered_at", "attempt"))
    return tries.groupBy(key, "doc_hash").agg(best.alias("best")).select(key, "doc_hash", "best.attempt", "best.failed")


def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How far the runs of a log have come, one row each; may be asked at any time, while a run goes on too.

    An answer counts once, however often it was logged; it counts as failed only if no attempt brought a text."""
    fields = "run string, doc_hash bigint, chunk_index int, chunk_tokens int, response_tokens bigint, error string, answered_at timestamp"
    schema = spark.createDataFrame([], fields).schema
    ok = F.col("error").isNull()
    once = read_answers(spark, folder, schema).groupBy("run", "doc_hash", "chunk_index").agg(
        F.max(ok).alias("ok"), F.max("chunk_tokens").alias("chunk_tokens"), F.max(F.when(ok, F.col("response_tokens"))).alias("response_tokens"),
        F.min("answered_at").alias("first"), F.max("answered_at").alias("last"),
    )
    return once.groupBy("run").agg(
        F.count("*").alias("answers"), F.count_if(~F.col("ok")).alias("failed_answers"), F.count_distinct("doc_hash").alias("documents"),
        F.sum("chunk_tokens").alias("chunk_tokens"), F.sum("response_tokens").alias("output_tokens"),
        F.min("first").alias("first_answer"), F.max("last").alias("last_answer"),
    )
