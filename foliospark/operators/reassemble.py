"""Responses back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 256


def chunk_output(index: Column, response: Column, error: Column) -> Column:
    """The text a chunk contributes: its answer, or a note about the failure."""
    note = F.concat(
        F.lit("[ERROR: Chunk "), (index + F.lit(1)).cast("string"), F.lit(" failed - "),
        F.coalesce(error, F.lit("no response")), F.lit("]"),
    )
    return F.when(error.isNull() & response.isNotNull(), response).otherwise(note)


def _join_parts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(order, "s"))).alias("cs"), F.sum("n").alias("n"))
        .select(*keys, "n", F.array_join(F.transform("cs", lambda c: c["s"]), "").alias("s"))
    )


def reassemble(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join answers in chunk order.

    Two steps: runs of ``SEGMENT`` chunks first, so that the chunks of a long document are collected and sorted by many
    tasks, then the runs of a document.  A document's last step meets one string per run.
    """
    out = chunk_output(F.col("chunk_index"), F.col("response"), F.col("error"))
    rows = responses.select(
        key, "chunk_index", F.floor(F.col("chunk_index") / SEGMENT).cast("int").alias("run"), out.alias("s"),
        F.lit(1).cast("bigint").alias("n"),
    )
    whole = _join_parts(_join_parts(rows, [key, "run"], "chunk_index"), [key], "run")
    return whole.select(key, F.col("n").alias("n_chunks"), F.col("s").alias("output_text"))


def with_empty_documents(docs: DataFrame, assembled: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every input document, also those that gave no chunks."""
    return docs.select(key).join(assembled, key, "left").select(
        key,
        F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"),
        F.coalesce("output_text", F.lit("")).alias("output_text"),
        F.when(F.col("n_chunks").isNull(), "empty").otherwise("ok").alias("status"),
    )
