"""Rate-limit headers, pacing delay and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import REQUESTS_SAFETY_MARGIN, TOKENS_SAFETY_MARGIN
from .tokens import col, let

# Header names.
H_LIMIT_REQUESTS = "x-ratelimit-limit-requests-day"
H_LIMIT_TOKENS = "x-ratelimit-limit-tokens-minute"
H_LEFT_REQUESTS = "x-ratelimit-remaining-requests-day"
H_LEFT_TOKENS = "x-ratelimit-remaining-tokens-minute"
H_RESET_TOKENS = "x-ratelimit-reset-tokens-minute"
H_RESET_REQUESTS = "x-ratelimit-reset-requests-day"

# Substrings that put an error message into a class.
RATE_LIMIT_WORDS = ("rate limit", "rate_limit", "too many requests", "429")
QUOTA_WORDS = ("quota", "token_quota_exceeded", "tokens per day limit", "daily limit")
SERVER_WORDS = ("server error", "please try again", "internal error", "error code: 500")
RETRY_STATUS = (500, 502, 503, 504, 429)
RETRY_STATUS_METADATA = (503, 502, 504, 429)

# Delays in seconds, and the rate where no header tells it.
MIN_DELAY = 0.1
DEFAULT_TOKENS_PER_MINUTE = 400_000
LOW_QUOTA_DELAY = 2.0

_INT = r"^\s*[+-]?\d+(?:_\d+)*\s*$"
_FLOAT = r"(?i)^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?\s*$"


def parse_rate_headers(headers: Column | str, now: Column | str) -> Column:
    """struct of limits, remaining counts and reset times.

    A count that is not an integer resets the whole status to its defaults; a
    reset time that is not a number loses only that field.  ``now`` is a column,
    so results do not depend on when the job runs.
    """
    h, at = col(headers), col(now)
    ints = {
        "requests_limit": H_LIMIT_REQUESTS, "tokens_limit": H_LIMIT_TOKENS,
        "requests_remaining": H_LEFT_REQUESTS, "tokens_remaining": H_LEFT_TOKENS,
    }
    resets = {"reset_time": H_RESET_TOKENS, "requests_reset_time": H_RESET_REQUESTS}

    def as_int(v):
        # Casts decide nearly all values; only digits grouped by "_" need the regex.
        grouped = F.when(v.contains("_") & v.rlike(_INT), F.replace(v, F.lit("_"), F.lit("")))
        return F.coalesce(v.try_cast("bigint"), grouped.try_cast("bigint"))

    def as_float(v):
        grouped = F.when(v.contains("_") & v.rlike(_FLOAT), F.replace(v, F.lit("_"), F.lit("")))
        number = F.coalesce(v.try_cast("double"), grouped.try_cast("double"))
        # The cast also takes Java's type suffixes and hexadecimal, which are no numbers here.
        low = F.lower(F.trim(v))
        java_only = (low.endswith("d") | low.endswith("f") | low.contains("x")) & ~low.endswith("inf")
        return F.when(~java_only & ~F.isnan(number), number)

    def parse(m):
        """One look at each header; everything else reads the parsed struct."""
        fields = []
        for name, header in ints.items():
            fields += [let(m[header], as_int).alias(name), m[header].isNotNull().alias(name + "_given")]
        for name, header in resets.items():
            fields.append(let(m[header], as_float).alias(name))
        return F.struct(*fields)

    def verdict(p):
        bad, found = F.lit(False), F.lit(False)
        for name in ints:
            bad = bad | (p[name + "_given"] & p[name].isNull())
            found = found | p[name + "_given"]
        for name in resets:
            bad = bad | F.coalesce(F.abs(p[name]) == F.lit(float("inf")), F.lit(False))
            found = found | p[name].isNotNull()
        return F.struct(p.alias("p"), (~bad).alias("ok"), (~bad & found).alias("parsed"))

    def build(v):
        def number(name):
            return F.when(v["ok"], F.coalesce(v["p"][name], F.lit(0))).otherwise(F.lit(0)).cast("bigint")

        def reset(name, default):
            micros = F.round(v["p"][name] * F.lit(1e6)).cast("bigint")
            after = F.timestamp_micros(F.unix_micros(at) + micros)
            return F.when(v["ok"], F.coalesce(after, at + default)).otherwise(at + default)

        return F.struct(
            number("requests_remaining").alias("requests_remaining"),
            number("tokens_remaining").alias("tokens_remaining"),
            number("tokens_limit").alias("tokens_limit"),
            number("requests_limit").alias("requests_limit"),
            reset("reset_time", F.expr("interval 1 minute")).alias("reset_time"),
            reset("requests_reset_time", F.expr("interval 1 day")).alias("requests_reset_time"),
            at.alias("last_updated"),
            v["parsed"].alias("headers_parsed"),
        )

    return let(let(let(h, parse), verdict), build)


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def backoff_delay(status: Column | str, next_tokens: Column | str, now: Column | str) -> Column:
    """Seconds to wait before the next request; the first rule that applies wins."""
    s, need, at = col(status), col(next_tokens), col(now)
    wait = seconds_between(at, s["reset_time"])
    pending = s["reset_time"] > at
    limit = F.when(s["tokens_limit"] > 0, s["tokens_limit"]).otherwise(F.lit(DEFAULT_TOKENS_PER_MINUTE))
    safe_rate = limit / F.lit(60.0) * F.lit(0.8)
    age = seconds_between(s["last_updated"], at)
    pace = need / safe_rate - F.lit(1.0)
    return (
        F.when(~s["headers_parsed"], F.lit(MIN_DELAY))
        .when((s["tokens_remaining"] < need) & pending, F.least(wait, F.lit(60.0)))
        .when(
            (s["tokens_remaining"] < need + F.lit(TOKENS_SAFETY_MARGIN)) & pending,
            F.least(F.greatest(wait * F.lit(0.1), F.lit(1.0)), F.lit(10.0)),
        )
        .when(
            (s["tokens_limit"] > 0) & (age < 1.0) & (need > safe_rate) & (pace > 0),
            F.least(pace, F.lit(2.0)),
        )
        .when(
            (s["requests_remaining"] >= 0) & (s["requests_remaining"] < REQUESTS_SAFETY_MARGIN),
            F.lit(LOW_QUOTA_DELAY),
        )
        .otherwise(F.lit(MIN_DELAY))
    )


def tokens_exhausted(status: Column | str, next_tokens: Column | str) -> Column:
    return col(status)["tokens_remaining"] < col(next_tokens)


def requests_exhausted(status: Column | str) -> Column:
    return col(status)["requests_remaining"] <= 0


def seconds_to_reset(reset_time: Column | str, now: Column | str) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(col(now), col(reset_time)))


def usage_percent(limit: Column | str, remaining: Column | str) -> Column:
    """Used share of a quota in percent; null without a limit."""
    lim = col(limit)
    return F.when(lim > 0, (lim - col(remaining)) / lim * F.lit(100.0))


def _mentions(message: Column, words) -> Column:
    return F.lower(message).rlike("|".join(words))


def classify_error(message: Column | str, status: Column | str | None = None) -> Column:
    """struct<rate_limit, quota, server, retryable> of an error message.

    With a status code column, ``retryable`` also honours the code.
    """
    m = col(message)
    rate, quota, server = (_mentions(m, w) for w in (RATE_LIMIT_WORDS, QUOTA_WORDS, SERVER_WORDS))
    retry = rate | quota | server
    if status is not None:
        retry = retry | col(status).isin(*RETRY_STATUS)
    return F.struct(
        rate.alias("rate_limit"), quota.alias("quota"), server.alias("server"), retry.alias("retryable")
    )


def retryable_status(status: Column | str, metadata_call: bool = False) -> Column:
    return col(status).isin(*(RETRY_STATUS_METADATA if metadata_call else RETRY_STATUS))
