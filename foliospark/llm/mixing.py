"""Mix sources to target weights by systematic sampling.

Sources in code point order, null last, get the weights of ``WEIGHTS`` in turn and share ``SHARE`` times all words.
A target stops at ``LIMIT`` times its source's words; what is above goes to the others by weight.

Every document of a source expects target / source words copies.  Their running sum within the source, plus one random
offset per source, crosses an integer once per copy to emit, so a document gets the expected number rounded down or up.
Documents are summed in order of size (ties by a hash of the id): neighbours in the sum are alike, which keeps a
source's words near its target although sizes differ by orders of magnitude.

The running sum is a rank, computed without a window over a whole source: a range partitioning by (source, size, hash)
numbers rows inside partitions, and one small row per (partition, source) carries the offsets.  A source with most of
the rows simply spans more partitions.

Null texts have size 0.  Rows that repeat an id are documents of their own.  A source without words has target 0 and no
copies.  The offset is derived from the seed and the source's name, so reruns agree.  Sizes
of very long texts are counted as any other's.  ``mix`` keeps the columns of its input, whatever their names.  Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import WORD, packed, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = "mix"
BROADCAST_ROWS = 100_000


def word_count(text_col: str = "text"):
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")))
    # Sources fill in order of capacity per weight.  The common level, were all before this one full, is largest at the
    # first that does not fill; every target is its weight times that level, or its own capacity if smaller.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capacity = F.lit(LIMIT) * F.col("source_size")
    full = F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - full) / open_weight
    return (
        per.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(capacity.cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def _crossings(rank, rate, source):
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    offset = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(1048576.0)
    return (F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))).cast("int")


def _copies(rows: DataFrame) -> DataFrame:
    """Add source_size, target and copies to rows with source, size, key."""
    order = [F.asc_nulls_last("source"), F.col("size"), F.md5(F.coalesce(F.col("key"), F.lit("")))]
    numbered = (
        rows.repartitionByRange(*order, "key").sortWithinPartitions(*order, "key").withColumn("seat", F.monotonically_increasing_id())
    )
    # The seat holds the partition in its upper bits; written once, it is the same for all that follows.
    numbered = durable(numbered, "mix-numbered").withColumn("part", F.shiftright("seat", 33))
    parts = numbered.groupBy("part", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("seat").alias("first_seat"), F.sum("size").alias("size")
    )
    parts = durable(parts, "mix-parts")
    targets = source_targets(parts).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parts = (
        parts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("part").alias("p_part"), F.col("source").alias("p_source"), "source_size", "target",
            rate.alias("rate"), (F.col("earlier") - F.col("first_seat") + 1).alias("shift"),
        )
    )
    # One row per partition and source it touches: broadcast if so few that it surely fits, else an ordinary join.
    parts = durable(parts, "mix-shifts")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    joined = numbered.join(parts, (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source")))
    return joined.withColumn("copies", _crossings(F.col("seat") + F.col("shift"), F.col("rate"), F.col("source")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
        F.col(id_col).cast("string").alias("key"),
    )
    return _copies(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all its columns."""
    rows = packed(
        docs, source=F.col(source_col).cast("string"), size=word_count(text_col), key=F.col(id_col).cast("string")
    )
    return _copies(rows).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
