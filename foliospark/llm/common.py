"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run without ASCII white space (fixed by the contract of the queries).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame, **extra) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that helper columns can't clash with them."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")
