"""Request-log reports: pacing, dispatch minutes and quota use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConfigError
from ..functions.rates import backoff_delay
from .ordered import lag_value, running_sums, time_bucket, with_carry

MINUTE = 60_000_000  # microseconds


def replay_pacing(log: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """The delay each request would have waited, from the status before it.

    ``log``: client, ts, request_id, tokens, status (struct).  The first request
    of a client is not delayed.
    """
    order = ["ts", "request_id"]
    seen = lag_value(
        log, "client", order, time_bucket("ts", bucket_seconds), F.col("status"), "last_status"
    )
    return seen.withColumn(
        "delay",
        F.when(F.col("last_status").isNull(), F.lit(0.0)).otherwise(
            backoff_delay("last_status", "tokens", F.col("ts"))
        ),
    )


def pacing_plan(
    log: DataFrame, tokens_per_minute: int, requests_per_minute: int, bucket_seconds: int = 3600
) -> DataFrame:
    """The earliest minute, counted from the first request of a client, in which a
    request still respects both rates on average: its position in the running
    token and request totals."""
    order = ["ts", "request_id"]
    bucket = time_bucket("ts", bucket_seconds)
    both = running_sums(
        log, "client", order, bucket,
        {"tokens_so_far": F.col("tokens").cast("bigint"), "requests_so_far": F.lit(1).cast("bigint")},
    )
    minute = F.greatest(
        F.floor((F.col("tokens_so_far") - F.col("tokens")) / tokens_per_minute),
        F.floor((F.col("requests_so_far") - 1) / requests_per_minute),
    )
    return both.withColumn("dispatch_minute", minute.cast("bigint"))


def dispatch_plan(
    log: DataFrame, tokens_per_minute: int, requests_per_minute: int, bucket_seconds: int = 3600
) -> DataFrame:
    """When each request of a client may be sent, so that no minute holds more than either limit.

    ``log``: client, ts, request_id, tokens.  Adds ``dispatch_at`` (timestamp), never before the arrival and in the order
    of arrival, and ``over_limit`` for requests larger than a whole minute's tokens, which are never sent.  The limits hold
    in every span of 60 seconds, not only from minute to minute.

    A request blocks its client for the share of a minute that its tokens, or its being a request, take.  The tokens of
    the last request of a span come on top of the share before it, so the largest ordinary request is held in reserve;
    a request over half the limit gets a minute before and after it for itself.  When a client is free again is
    ``max(arrival, free before + pause) + share``.  Such steps join to one step of the same form, so buckets of time are
    scanned on their own, one small row per bucket carries a client's state across, and a busy client is many tasks.
    Requests without a time come first and may be sent at once.  One pass before finds the reserve.
    """
    if tokens_per_minute < 2 or requests_per_minute < 1:
        raise ConfigError("limits must be at least two tokens and one request a minute")
    tokens, half = F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint"), tokens_per_minute // 2
    reserve = log.agg(F.max(F.when(tokens <= half, tokens))).first()[0] or 0
    rate = tokens_per_minute - reserve
    over, alone = tokens > tokens_per_minute, tokens > half
    share = F.greatest(F.ceil(tokens * MINUTE / F.lit(rate)).cast("bigint"), F.lit(-(-MINUTE // requests_per_minute)).cast("bigint"))
    share = F.when(over, F.lit(0)).when(alone, F.lit(MINUTE)).otherwise(share).cast("bigint")
    pause = F.when(alone & ~over, F.lit(MINUTE)).otherwise(F.lit(0)).cast("bigint")
    arrival = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).cast("bigint")
    steps = log.withColumn("_bucket", time_bucket("ts", bucket_seconds)).withColumns(
        {"_share": share, "_least": F.when(~over, arrival + share), "_more": pause + share, "over_limit": over}
    )
    order = ["ts", "request_id"]
    # free = more so far + the largest (least - more so far) seen; a carried row has the state before as its ``_least``.
    def scanned(df, by, first):
        frame = Window.partitionBy(*by).orderBy(*first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("_sum", F.sum("_more").over(frame))
        return df.withColumn("_free", F.col("_sum") + F.max(F.col("_least") - F.col("_sum")).over(frame))

    buckets = (
        scanned(steps, ["client", "_bucket"], order)
        .groupBy("client", "_bucket")
        .agg(F.max("_sum").alias("_more"), F.max(F.col("_free") - F.col("_sum")).alias("_least"))
        .withColumn("_least", F.col("_least") + F.col("_more"))
    )
    by_client = Window.partitionBy("client").orderBy("_bucket")
    carry = scanned(buckets, ["client"], ["_bucket"]).select(
        "client", "_bucket", F.lag("_free").over(by_client).alias("_least"), F.lit(0).cast("bigint").alias("_more"))
    done = scanned(with_carry(steps, carry), ["client", "_bucket"], ["_real", *order]).filter("_real = 1")
    at = F.when(~F.col("over_limit"), F.timestamp_micros(F.col("_free") - F.col("_share")))
    return done.withColumn("dispatch_at", at).drop("_bucket", "_share", "_least", "_more", "_sum", "_free", "_real")


def quota_by_window(
    log: DataFrame, width: str, token_limit: int, request_limit: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """Tokens and requests per tumbling window, against the limits."""
    return (
        log.groupBy(F.window("ts", width).alias("w"), *by)
        .agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"),
            *by,
            "tokens",
            "requests",
            (F.col("tokens") > token_limit).alias("tokens_over"),
            (F.col("requests") > request_limit).alias("requests_over"),
        )
    )
