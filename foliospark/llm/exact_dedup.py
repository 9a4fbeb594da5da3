"""Exact deduplication with a heavy-hitter split.

Texts are equal when their UTF-8 bytes are equal; SHA-256 digests stand for them (null counts as the empty text).
Misra-Gries summaries, one per partition, find the digests that may be frequent.  At most ``counters`` of them remain
after merging, so the table of their verified winners has a proven bound and is broadcast: the losing rows of a frequent
digest are settled in the map task that read them and never shuffled.  All other rows meet by an ordinary shuffle on the
digest, where no group holds more than about 2/``counters`` of the rows.

Of equal texts, the row with the largest id stays; a null id loses against any other, and of rows that repeat both id
and text exactly one stays.  A very long text travels as its digest.  ``drop_exact_copies`` keeps the columns of its
input, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import packed, text_or_empty, unpacked

COUNTERS = 512


def digest_of(text_col: str = "text"):
    return F.sha2(text_or_empty(text_col), 256)


def misra_gries(keys: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of the string column ``key``, among them all that more than
    2 / (counters + 1) of the rows have.  Column ``digest`` only; counts must be verified."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch["digest"].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters:
                held -= int(held.nlargest(counters + 1).iloc[-1])
                held = held[held > 0]
        yield pd.DataFrame({"digest": held.index.astype(str), "weight": held.to_numpy("int64")})

    parts = keys.select(F.col(key).alias("digest")).mapInPandas(summarise, "digest string, weight long")
    return (
        parts.groupBy("digest")
        .agg(F.sum("weight").alias("weight"))
        .orderBy(F.desc("weight"), "digest")
        .limit(counters)
        .select("digest")
    )


def frequent_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, win_id, win_n) with exact counts, for at most ``counters`` digests of (doc_id, digest) rows."""
    return (
        digests.join(F.broadcast(misra_gries(digests, "digest", counters)), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("win_id"), F.count(F.lit(1)).alias("win_n"))
        .filter("win_n > 1")
    )


def with_winners(rows: DataFrame, winners: DataFrame) -> DataFrame:
    lost = F.col("win_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("win_id")))
    return rows.join(F.broadcast(winners), "digest", "left").withColumn("lost", lost)


def place_in_group():
    return F.row_number().over(Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = durable(docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest")), "digests")
    winners = durable(frequent_winners(digests, counters), "winners")
    rows = with_winners(digests, winners)
    settled = rows.filter("lost").select(
        "doc_id", F.col("win_id").alias("keep_id"), F.col("win_n").alias("group_size"), F.lit(False).alias("kept"), "digest"
    )
    group = Window.partitionBy("digest")
    met = rows.filter(~F.col("lost")).select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce(F.col("win_n"), F.count(F.lit(1)).over(group)).alias("group_size"),
        (place_in_group() == 1).alias("kept"),
        "digest",
    )
    return settled.unionByName(met).withColumnRenamed("digest", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all its columns."""
    digests = durable(docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest")), "digests")
    winners = durable(frequent_winners(digests, counters), "winners")
    rows = with_winners(packed(docs, doc_id=F.col(id_col), digest=digest_of(text_col)), winners)
    return unpacked(rows.filter(~F.col("lost")).withColumn("place", place_in_group()).filter("place = 1"))
