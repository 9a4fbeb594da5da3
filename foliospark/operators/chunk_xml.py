"""XML chunker: normalise, take top-level elements, pack them, wrap each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_newlines, split_lines
from ..functions.tokens import max_chars, token_count
from ..functions.text import windows
from ..functions.xml import xml_children, xml_parts, xml_wrap
from .pack import greedy_cuts, span


def _piece(text: Column, tk: Column, group: Column) -> Column:
    return F.struct(text.alias("text"), tk.alias("token_count"), group.alias("grouped"))


def _render(cuts: Column, items: Column, chunk_size: int, grouped: Column) -> Column:
    def expand(c):
        joined = F.array_join(span(items, c["st"], c["n"]), "")
        parts = F.transform(
            windows(F.element_at(items, c["st"] + F.lit(1)), max_chars(chunk_size)),
            lambda s: _piece(s, token_count(s), F.lit(False)),
        )
        return F.when(c["solo"], parts).otherwise(F.array(_piece(joined, c["tk"], grouped)))

    return F.flatten(F.transform(cuts, expand))


def _explode_wrapped(df: DataFrame) -> DataFrame:
    """One row per chunk; only packed groups visit the Python parser."""
    keep = [c for c in df.columns if c != "pieces"]
    counted = F.transform(
        "pieces",
        lambda p: F.struct(
            p["text"].alias("text"), p["token_count"].alias("token_count"),
            p["grouped"].alias("grouped"), F.size("pieces").alias("n"),
        ),
    )
    rows = (
        df.withColumn("pieces", counted)
        .select(*keep, F.posexplode_outer("pieces"))
        .filter(F.col("pos").isNotNull())
        .withColumn("wrapped", xml_wrap(F.when(F.col("col.grouped"), F.col("col.text"))))
    )
    return rows.select(
        *keep,
        F.col("pos").alias("chunk_index"),
        F.col("col.n").alias("n_chunks"),
        F.coalesce("wrapped", F.col("col.text")).alias("text"),
        F.when(F.col("wrapped").isNotNull(), token_count("wrapped"))
        .otherwise(F.col("col.token_count"))
        .alias("token_count"),
    )


def pack_elements(df: DataFrame, chunk_size: int) -> DataFrame:
    """Pack an ``elements array<string>`` column into wrapped chunks."""
    return _explode_wrapped(
        df.withColumn("cuts", greedy_cuts(F.transform("elements", token_count), chunk_size))
        .withColumn("pieces", _render(F.col("cuts"), F.col("elements"), chunk_size, F.lit(True)))
        .drop("cuts", "elements")
    )


def chunk_xml(docs: DataFrame, chunk_size: int) -> DataFrame:
    """Documents that fit stay whole; texts without elements are packed by lines."""
    keep = [c for c in docs.columns if c != "text"]
    df = docs.select(*keep, xml_parts(norm_newlines("text"), F.lit(chunk_size)).alias("_x")).select(
        *keep, F.col("_x.norm").alias("norm"), F.col("_x.elements").alias("elements")
    )
    by_lines = F.size("elements") == 0
    df = (
        df.withColumn("by_lines", by_lines)
        .withColumn(
            "items", F.when(F.col("by_lines"), split_lines("norm")).otherwise(F.col("elements"))
        )
        .withColumn("cuts", greedy_cuts(F.transform("items", token_count), chunk_size))
    )
    pieces = F.when(
        F.col("items").isNull(), F.array(_piece(F.col("norm"), token_count("norm"), F.lit(False)))
    ).otherwise(_render(F.col("cuts"), F.col("items"), chunk_size, ~F.col("by_lines")))
    return _explode_wrapped(
        df.withColumn("pieces", pieces).drop("norm", "elements", "by_lines", "items", "cuts")
    )


def chunk_xml_children(docs: DataFrame, chunk_size: int) -> DataFrame:
    """Pack the children of the root element instead of the root itself."""
    return pack_elements(
        docs.withColumn("elements", xml_children(norm_newlines("text"))).drop("text"), chunk_size
    )
