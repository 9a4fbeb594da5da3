"""Requests: one per chunk, with metadata and continuity context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_CONTEXT_TOKENS, ConfigError, JobConfig
from ..functions.budget import completion_budget, continuity_block, fit_to_budget, tail_sample
from ..functions.metadata import metadata_context
from ..functions.tokens import exact, token_count

MESSAGES = "array<struct<role:string,content:string>>"


def messages(system: Column, user: Column) -> Column:
    def one(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(one("system", system), one("user", user))


def too_large(total: Column) -> Column:
    return F.concat(
        F.lit("Input too large: "), total.cast("string"),
        F.lit(f" tokens > {MAX_CONTEXT_TOKENS} limit"),
    )


def prepare_requests(chunks: DataFrame, config: JobConfig) -> DataFrame:
    """The parts of a request that do not depend on earlier responses."""
    has_meta = "metadata" in chunks.columns
    context = metadata_context("metadata", config.quirks) if has_meta else F.lit("")
    return chunks.withColumn("metadata_context", context).withColumn(
        "max_completion_tokens", completion_budget("token_count", config.max_tokens_ratio)
    )


def build_requests(prepared: DataFrame, config: JobConfig, continuity: str | None = None) -> DataFrame:
    """Messages and token totals; a request over the context limit is an error row."""
    parts = [F.col("metadata_context")]
    if continuity:
        parts.append(F.col(continuity))
    count = config.counter.column if exact(config.counter) else token_count
    df = prepared.withColumn("user_content", F.concat(*parts, F.col("text"))).withColumn(
        "total_input_tokens", (F.lit(config.prompt_tokens) + count("user_content")).cast("int")
    )
    fits = F.col("total_input_tokens") <= MAX_CONTEXT_TOKENS
    return df.withColumn(
        "messages", F.when(fits, messages(F.lit(config.prompt), F.col("user_content")))
    ).withColumn("error", F.when(~fits, too_large(F.col("total_input_tokens"))))


def attach_responses(chunks: DataFrame, responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Responses back to their chunks; a chunk without one keeps nulls."""
    narrow = responses.select(key, "chunk_index", "response", "error")
    return chunks.join(narrow, [key, "chunk_index"], "left")


def replay_continuity(answered: DataFrame, config: JobConfig, key: str = "doc_id") -> DataFrame:
    """Rebuild from stored responses the continuity each chunk was sent with.

    ``answered`` has key, chunk_index, text, token_count, response, error.  Samples
    are cut to their tail before the window sorts them, and a failed chunk is
    skipped.
    """
    if exact(config.counter):
        raise ConfigError("the replay cuts by characters; answers under a token counter are sent with cuts of their own")
    before = (
        Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    )
    pair = F.struct(
        tail_sample("text", config.sample_size).alias("in_tail"),
        tail_sample("response", config.sample_size).alias("out_tail"),
    )
    ok = F.col("error").isNull() & F.col("response").isNotNull()
    base = F.lit(config.prompt_tokens) + F.col("token_count")
    block = F.coalesce(continuity_block(F.col("prev.in_tail"), F.col("prev.out_tail")), F.lit(""))
    return (
        answered.withColumn("pair", F.when(ok, pair))
        .drop("response", "error")
        .withColumn("prev", F.last("pair", ignorenulls=True).over(before))
        .withColumn("block", block)
        .withColumn("continuity", fit_to_budget("block", base))
        .drop("pair", "prev", "block")
    )


def conversation_requests(turns: DataFrame, limit: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """One message list per conversation.

    Token totals are summed first (with map-side combine).  Turns of conversations
    over the limit are then dropped, and only the rest is collected, so a message
    list is never larger than ``limit`` tokens; a longer conversation becomes an
    error row without messages, however many turns it holds.  The dropped set is
    short (each member holds more than ``limit`` tokens), so Spark broadcasts it
    where its measured size allows, and a hot conversation is not gathered anywhere.
    """
    totals = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.sum(token_count("text")).cast("bigint").alias("total_tokens"),
    )
    long = totals.filter(F.col("total_tokens") > limit).select("conv_id")
    one = F.struct("turn", "role", F.col("text").alias("content"))
    lists = (
        turns.join(long, "conv_id", "left_anti")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(one)).alias("ordered"))
        .select(
            "conv_id",
            F.transform("ordered", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
                "messages"
            ),
        )
    )
    over = F.col("total_tokens") > limit
    return totals.join(lists, "conv_id", "left").select(
        "conv_id",
        "n_messages",
        "total_tokens",
        "messages",
        over.alias("over_limit"),
        F.when(over, too_large(F.col("total_tokens"))).alias("error"),
    )
