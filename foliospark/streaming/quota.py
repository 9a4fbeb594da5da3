"""Quota meter over a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pacing import quota_by_window


def stream_quota(
    log: DataFrame, width: str, lateness: str, token_limit: int, request_limit: int
) -> DataFrame:
    """Tumbling windows of tokens and requests; rows later than ``lateness`` are dropped.

    ``ts`` is cast to a timestamp with time zone, which watermarks require.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return quota_by_window(timed, width, token_limit, request_limit)
