"""Streams of documents: the batch functions on ``readStream`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import JobConfig
from ..operators.registry import create_chunks
from ..session import fresh_path
from ..sources.manifest import folder_exists


def read_stream(
    spark: SparkSession, folder: str, schema, pattern: str | None = None, max_files: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_chunks(docs: DataFrame, config: JobConfig) -> DataFrame:
    """Chunking is stateless per document, so the batch plan is the stream plan."""
    return create_chunks(docs, config)


def start_parquet(df: DataFrame, name: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a parquet folder; the file sink commits each batch once."""
    writer = (
        df.writeStream.format("parquet")
        .queryName(name)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(df: DataFrame, name: str, timeout: int | None = None) -> DataFrame:
    """Run a stream over everything available and read back what it wrote; ``timeout`` in seconds, none by default."""
    spark = df.sparkSession
    base = fresh_path(spark, name)
    query = start_parquet(df, name + "-" + base[-8:], base + "/data", base + "/checkpoint")
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout} s")
    return spark.read.schema(df.schema).parquet(base + "/data")


#: Parts of a target by the hash of its key.
KEY_BUCKETS = 64


def finished_keys(spark: SparkSession, target: str, key: str, kind: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """Keys that other batches have written, read from the buckets of this batch's keys only."""
    met = [r.bucket for r in batch.select("bucket").distinct().collect()]  # KEY_BUCKETS at most
    done = spark.read.schema(f"{key} {kind}, bucket int, batch bigint").parquet(target)
    return done.filter(F.col("bucket").isin(met) & (F.col("batch") != batch_id)).select(key)


def start_deduplicated(
    docs: DataFrame, target: str, checkpoint: str, key: str = "doc_id", once: bool = True, buckets: int = KEY_BUCKETS
) -> StreamingQuery:
    """Append only documents whose output is not there yet.

    The target is partitioned by a hash of the key, and a batch is anti-joined with the finished keys (one narrow column)
    of the buckets it meets, so its cost follows its own keys and not all that was ever written.  Each batch writes
    partitions of its own, so a batch replayed after a failure overwrites itself instead of adding rows.  ``buckets`` must
    stay the same for a target.
    """
    kind = docs.schema[key].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if folder_exists(target):  # a folder without batches yet has no columns to infer
            fresh = fresh.join(finished_keys(spark, target, key, kind, fresh, batch_id), key, "left_anti")
        placed = fresh.withColumn("batch", F.lit(batch_id).cast("bigint")).repartition("bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
