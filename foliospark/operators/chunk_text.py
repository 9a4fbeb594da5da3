"""Line based chunkers: plain text and blank-line paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_newlines, split_lines, strip
from ..functions.tokens import CHARS_PER_TOKEN, TokenCounter, exact, let, token_count
from .pack import blocked_fold, greedy_cuts, render


def explode_pieces(df: DataFrame) -> DataFrame:
    """``pieces array<struct<text,token_count>>`` to one row per chunk.

    Two things keep the optimizer from evaluating the fold a second time.  A plain
    explode would infer a ``size(pieces) > 0`` filter below it, so the outer form
    is used.  And the chunk count travels inside the array elements, so a later
    filter on it cannot be pushed below the explode.
    """
    keep = [c for c in df.columns if c != "pieces"]
    counted = F.transform(
        "pieces",
        lambda p: F.struct(
            p["text"].alias("text"), p["token_count"].alias("token_count"), F.size("pieces").alias("n")
        ),
    )
    out = df.withColumn("pieces", counted).select(*keep, F.posexplode_outer("pieces"))
    return out.filter(F.col("pos").isNotNull()).select(
        *keep,
        F.col("pos").alias("chunk_index"),
        F.col("col.n").alias("n_chunks"),
        F.col("col.text").alias("text"),
        F.col("col.token_count").alias("token_count"),
    )


def text_pieces(df: DataFrame, chunk_size: int, text: str = "text", counter: TokenCounter | None = None) -> DataFrame:
    """Add ``pieces``: greedy line packing by the sum of per-line tokens."""
    if exact(counter):
        return (
            df.withColumn("lines", split_lines(norm_newlines(text)))
            .withColumn("sized", counter.sized("lines", chunk_size))
            .withColumn("cuts", greedy_cuts(F.transform("sized", lambda x: x["k"]), chunk_size))
            .withColumn("pieces", render(F.col("cuts"), F.col("lines"), chunk_size, F.col("sized")))
            .drop("lines", "sized", "cuts", text)
        )
    return (
        df.withColumn("lines", split_lines(norm_newlines(text)))
        .withColumn("cuts", greedy_cuts(F.transform("lines", token_count), chunk_size))
        .withColumn("pieces", render(F.col("cuts"), F.col("lines"), chunk_size))
        .drop("lines", "cuts", text)
    )


def chunk_text(docs: DataFrame, chunk_size: int, counter: TokenCounter | None = None) -> DataFrame:
    return explode_pieces(text_pieces(docs, chunk_size, counter=counter))


def split_overlong(docs: DataFrame, chunk_size: int, counter: TokenCounter | None = None) -> DataFrame:
    """Cut whole texts by size alone."""
    if exact(counter):
        items = F.when(F.length("text") > 0, F.array("text")).otherwise(F.array().cast("array<string>"))
        whole = lambda x: F.array(F.struct(F.col("text").alias("text"), x["k"].alias("token_count")))
        pieces = F.flatten(F.transform("sized", lambda x: F.coalesce(x["parts"], whole(x))))
        return explode_pieces(docs.withColumn("sized", counter.sized(items, chunk_size)).withColumn("pieces", pieces).drop("sized", "text"))
    cuts = F.when(
        F.length("text") > 0,
        F.array(
            F.struct(
                F.lit(0).alias("st"), F.lit(1).alias("n"), token_count("text").alias("tk"), F.lit(True).alias("solo")
            )
        ),
    ).otherwise(F.array().cast("array<struct<st:int,n:int,tk:int,solo:boolean>>"))
    return explode_pieces(
        docs.withColumn("items", F.array("text"))
        .withColumn("cuts", cuts)
        .withColumn("pieces", render(F.col("cuts"), F.col("items"), chunk_size))
        .drop("items", "cuts", "text")
    )


def paragraph_pieces(text: Column, chunk_size: int) -> Column:
    """Paragraph packing: parts between blank lines, joined while they fit.

    Sizes are characters, chunks are stripped, a part longer than the size stays
    whole.
    """
    cap = F.lit(CHARS_PER_TOKEN * chunk_size)
    kind = "array<string>"

    def state(cur, out):
        return F.struct(cur.alias("cur"), out.alias("out"))

    def closed(a):
        return F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])

    def step(a, p):
        return (
            F.when(F.length(a["cur"]) + F.length(p) > cap, state(p, closed(a)))
            .when(a["cur"] == "", state(p, a["out"]))
            .otherwise(state(F.concat(a["cur"], F.lit("\n\n"), p), a["out"]))
        )

    folded = blocked_fold(F.split(text, "\n\n", -1), {"cur": F.lit("")}, kind, step)
    return F.transform(
        F.transform(let(folded, closed), strip),
        lambda s: F.struct(s.alias("text"), token_count(s).alias("token_count")),
    )


def chunk_paragraph(docs: DataFrame, chunk_size: int) -> DataFrame:
    return explode_pieces(
        docs.withColumn("pieces", paragraph_pieces(F.col("text"), chunk_size)).drop("text")
    )
