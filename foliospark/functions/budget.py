"""Token budgets and continuity context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    MAX_CONTEXT_TOKENS,
    MAX_OUTPUT_TOKENS,
    MIN_COMPLETION_TOKENS,
    REASONING_PERCENT,
)
from .tokens import CHARS_PER_TOKEN, col, token_count

# The text around the two samples of a continuity block.
CONTINUITY_HEAD = "\n---\n### Previous Input:\n"
CONTINUITY_MIDDLE = "\n\n---\n### Previous Output:\n"
CONTINUITY_TAIL = (
    "\n\n---\n\nBased on the preceding context, please process the current input text, "
    "maintaining logical and stylistic continuity.\n"
)
MIN_USEFUL_TOKENS = 20
BUFFER_TOKENS = 1_000


def completion_budget(chunk_tokens: Column | str, ratio: Column | int) -> Column:
    """Completion tokens to ask for: ratio, reasoning headroom and floor, capped."""
    ct = col(chunk_tokens).cast("bigint")
    r = F.lit(ratio) if isinstance(ratio, int) else ratio
    wanted = F.greatest(
        F.floor(ct * r / F.lit(100)).cast("bigint"),
        F.floor((ct * F.lit(REASONING_PERCENT) + F.lit(99)) / F.lit(100)).cast("bigint"),
        F.lit(MIN_COMPLETION_TOKENS).cast("bigint"),
    )
    return F.when(ct < 0, F.raise_error(F.lit("chunk_tokens must be non-negative"))).otherwise(
        F.least(F.lit(MAX_OUTPUT_TOKENS).cast("bigint"), wanted).cast("int")
    )


def model_budget(budget: Column | str, model_max: Column | str) -> Column:
    return F.least(col(budget), col(model_max)).cast("int")


def tail_sample(text: Column | str, sample_size: int) -> Column:
    """The last ``sample_size`` tokens of a text, four characters each."""
    if sample_size <= 0:
        return F.lit("")
    return F.right(col(text), F.lit(CHARS_PER_TOKEN * sample_size))


def continuity_block(input_tail: Column | str, output_tail: Column | str) -> Column:
    """Context block; empty when either sample is missing or empty."""
    a, b = col(input_tail), col(output_tail)
    block = F.concat(F.lit(CONTINUITY_HEAD), a, F.lit(CONTINUITY_MIDDLE), b, F.lit(CONTINUITY_TAIL))
    usable = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(usable, block).otherwise(F.lit(""))


def shortened_length(length: int, room: int) -> int:
    """Characters kept of a text of ``length`` for which ``room`` tokens are left: all, else the longest of length / 2,
    / 4, ... that fits; 0 if that is below MIN_USEFUL_TOKENS."""
    most = CHARS_PER_TOKEN * room - 1
    if length <= most:
        return length
    shift = max(1, length.bit_length() - max(most, 0).bit_length())
    shift += length >> shift > most
    kept = length >> shift
    return kept if kept <= most and kept // CHARS_PER_TOKEN + 1 >= MIN_USEFUL_TOKENS else 0


def fit_to_budget(block: Column | str, base: Column | str, limit: int = MAX_CONTEXT_TOKENS) -> Column:
    """Halve a block until it fits beside ``base`` tokens; give up below 20 tokens."""
    b, used = col(block), col(base)
    n = F.length(b)

    def toks(k):
        return F.shiftright(F.call_function("shiftright", n, k), 2) + F.lit(1)

    k = F.get(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda k: used + toks(k) <= F.lit(limit)), F.lit(0)
    )
    halved = F.when(
        k.isNotNull() & (toks(k) >= F.lit(MIN_USEFUL_TOKENS)),
        b.substr(F.lit(1), F.call_function("shiftright", n, k)),
    ).otherwise(F.lit(""))
    return (
        F.when(b == "", b)
        .when(used + token_count(b) <= limit, b)
        .when(used >= limit, F.lit(""))
        .otherwise(halved)
    )


def continuity_budget(
    chunk_tokens: Column | str, base: Column | str, sample_size: int, limit: int = MAX_CONTEXT_TOKENS
) -> Column:
    room = F.lit(limit - BUFFER_TOKENS) - col(chunk_tokens) - col(base)
    return F.greatest(F.lit(0), F.least(room, F.lit(2 * sample_size))).cast("int")
