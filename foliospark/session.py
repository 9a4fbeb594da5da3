"""Session helpers: partition spread and durable tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_BYTES_PER_TASK = 1 << 18


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan that is too coarse for its size over more tasks.

    A small table often arrives as one row group, so one task.  Tables that
    already have enough partitions pass through without a shuffle.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = min(spark.sparkContext.defaultParallelism, max(1, size // _BYTES_PER_TASK))
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``, else a folder in the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's process ends."""
    if not _MADE:
        atexit.register(remove_intermediate)
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_intermediate() -> None:
    """Delete what :func:`fresh_path` has named in this process, once no result needs it any more."""
    from pyarrow import fs

    while _MADE:
        store, name = fs.FileSystem.from_uri(_MADE.pop())
        if store.get_file_info(name).type == fs.FileType.Directory:
            store.delete_dir(name)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: lineage is cut and lost executors cost no recompute."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
