"""Aggregates over chunks, responses and document results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Failures listed per document without output.
SHOWN = 3


def _bigint(c, name):
    return c.cast("bigint").alias(name)


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"),
        _bigint(F.sum("token_count"), "total_tokens"),
        (F.sum("token_count") / F.count("*")).alias("avg_tokens"),
    )


def dry_run_report(chunks: DataFrame, data_format: str, prompt_tokens: int, *by: str) -> DataFrame:
    """What a run would send, without sending it."""
    total, n = F.sum("token_count"), F.count("*")
    return chunks.groupBy(*by).agg(
        F.lit(data_format).alias("data_format"),
        n.alias("total_chunks"),
        _bigint(total, "total_input_tokens"),
        _bigint(F.floor(total / n), "avg_chunk_size"),
        F.max("token_count").alias("max_chunk_size"),
        F.min("token_count").alias("min_chunk_size"),
        n.alias("estimated_calls"),
        _bigint(total + n * F.lit(prompt_tokens), "estimated_input_tokens"),
    )


def doc_state(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals of the successful calls of each document."""
    ok = F.col("error").isNull()
    processed = F.count_if(ok)
    tokens_in = F.coalesce(F.sum(F.when(ok, F.col("total_input_tokens"))), F.lit(0))
    tokens_out = F.coalesce(F.sum(F.when(ok, F.col("response_tokens"))), F.lit(0))

    def average(total):
        return F.when(processed == 0, F.lit(0.0)).otherwise(total / processed)

    return responses.groupBy(key).agg(
        F.count("*").alias("n_chunks"),
        processed.alias("chunks_processed"),
        _bigint(tokens_in, "total_input_tokens"),
        _bigint(tokens_out, "total_output_tokens"),
        average(tokens_in).alias("avg_input_tokens"),
        average(tokens_out).alias("avg_output_tokens"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("processing_time"),
        _bigint(F.coalesce(F.sum(F.when(ok, F.col("response_chars"))), F.lit(0)), "response_chars"),
        F.min_by("error", F.when(~ok, F.col("chunk_index"))).alias("first_error"),
    )


def with_status(state: DataFrame) -> DataFrame:
    """ok, partial (some chunk failed) or failed (nothing came back)."""
    return state.withColumn(
        "status",
        F.when((F.col("chunks_processed") == 0) | (F.col("response_chars") == 0), "failed")
        .when(F.col("chunks_processed") < F.col("n_chunks"), "partial")
        .otherwise("ok"),
    )


def zero_output(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents for which no chunk brought any text, with their first ``SHOWN`` failures.

    All their chunks failed, so the first to show are simply the first numbers; ``n_more`` counts the rest.
    """
    got = F.col("error").isNull() & (F.col("response_chars") > 0)
    note = F.concat((F.col("chunk_index") + 1).cast("string"), F.lit(": "), F.coalesce("error", F.lit("no text")))
    early = F.when(F.col("chunk_index") < SHOWN, F.struct("chunk_index", note.alias("note")))
    return (
        responses.groupBy(key)
        .agg(
            F.count("*").alias("n_chunks"),
            F.count_if(got).alias("n_ok"),
            F.array_sort(F.collect_list(early)).alias("early"),
        )
        .filter(F.col("n_ok") == 0)
        .select(
            key, "n_chunks",
            F.array_join(F.transform("early", lambda e: e["note"]), "\n").alias("shown"),
            F.greatest(F.lit(0).cast("bigint"), F.col("n_chunks") - SHOWN).alias("n_more"),
        )
    )


def run_summary(states: DataFrame) -> DataFrame:
    """One row for the run; a failed document adds nothing to the totals."""
    ok = F.col("status") != "failed"
    n = F.count_if(ok)

    def total(c, zero=0):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(zero))

    return states.agg(
        n.alias("successful"),
        F.count_if(~ok).alias("failed"),
        _bigint(total("total_input_tokens"), "total_input_tokens"),
        _bigint(total("total_output_tokens"), "total_output_tokens"),
        total("processing_time", 0.0).alias("total_time"),
        F.when(n == 0, F.lit(0.0)).otherwise(total("processing_time", 0.0) / n).alias("avg_time"),
    )


def throughput(states: DataFrame, *by: str) -> DataFrame:
    tokens, time = F.sum("total_output_tokens"), F.sum("processing_time")
    return states.groupBy(*by).agg(
        _bigint(tokens, "output_tokens"),
        F.when(time > 0, tokens / time).otherwise(F.lit(0.0)).alias("tokens_per_second"),
    )


def model_usage(responses: DataFrame) -> DataFrame:
    return (
        responses.filter(F.col("error").isNull())
        .groupBy("model")
        .agg(
            F.count("*").alias("n_chunks"),
            _bigint(F.sum("total_input_tokens"), "input_tokens"),
            _bigint(F.sum("response_tokens"), "output_tokens"),
        )
    )


def failures(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per failed chunk; numbering from 1 as in the error note."""
    return responses.filter(F.col("error").isNotNull()).select(
        key, (F.col("chunk_index") + 1).alias("chunk_number"), "error"
    )


def progress(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Done and remaining calls after each chunk.

    The chunker already numbers chunks and knows their count, so no window and no
    shuffle are needed.
    """
    return chunks.select(
        key,
        "chunk_index",
        (F.col("chunk_index") + 1).alias("done"),
        F.col("n_chunks").alias("total"),
        (F.col("n_chunks") - F.col("chunk_index") - 1).alias("remaining"),
    )


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First ``k`` rows per group and how many more there are.

    The rank filter lets Spark keep only ``k`` rows per group in each task before
    the shuffle; the counts are a separate aggregation with map-side combine.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return (
        ranked.filter(F.col("rank") <= k)
        .join(counts, group)
        .withColumn("n_more", F.greatest(F.lit(0).cast("bigint"), F.col("_n") - k))
        .drop("_n")
    )
