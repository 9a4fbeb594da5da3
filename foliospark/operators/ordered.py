"""Ordered per-key operations that survive a hot key.

A plain window puts all rows of a key into one task.  Here time is cut into
buckets; windows run per (key, bucket), one small row per bucket carries the state
across, and only that bucket table is windowed by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(ts: Column | str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts) / seconds)


def with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    """``df`` and one carried row per (key, bucket), told apart by ``_real``; a window then sees what came before its
    bucket without a join, and rows with a null key or time take part like any others."""
    return df.withColumn("_real", F.lit(1)).unionByName(carry.withColumn("_real", F.lit(0)), allowMissingColumns=True)


def lag_value(
    df: DataFrame, key: str, order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Add the ``value`` of the previous row of the same key; null times come first."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    carry = (
        df.groupBy(key, "_bucket")
        .agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        .withColumn("_value", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")))
        .select(key, "_bucket", "_value")
    )
    inner = Window.partitionBy(key, "_bucket").orderBy("_real", *order)
    return (
        with_carry(df, carry)
        .withColumn(name, F.lag("_value").over(inner))
        .filter("_real = 1")
        .drop("_bucket", "_value", "_real")
    )


def running_sums(df: DataFrame, key: str, order: list[str], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Add for each name the running sum of its value within a key, the row itself included."""
    df = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(key, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    carry = carry.select(key, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_v_{n}") for n in values])
    inner = Window.partitionBy(key, "_bucket").orderBy("_real", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        with_carry(df, carry)
        .withColumns({n: F.sum(f"_v_{n}").over(inner) for n in values})
        .filter("_real = 1")
        .drop("_bucket", "_real", *[f"_v_{n}" for n in values])
    )


def running_sum(
    df: DataFrame, key: str, order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Add the running sum of one ``value``."""
    return running_sums(df, key, order, bucket, {name: value})
