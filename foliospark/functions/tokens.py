"""Token counting.

The default counter is the character estimate ``length div 4 + 1`` (so the empty
string counts one token).  It is a plain Column expression and runs inside the
JVM.  A real tokenizer plugs in through :class:`ArrowTokenCounter`: chunkers then
pack by its counts, and cut long lines, samples and context where its counts say.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters per token in the estimate.
CHARS_PER_TOKEN = 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that ``body`` uses several times: evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_count(text: Column | str) -> Column:
    """``length(text) div 4 + 1`` as INT."""
    return (F.shiftright(F.length(col(text)), 2) + F.lit(1)).cast("int")


def max_chars(chunk_size: int) -> int:
    """Longest string that still counts at most ``chunk_size`` tokens."""
    return CHARS_PER_TOKEN * chunk_size - 1


class Measure:
    """What a task asks of a counter.  Cuts are searched for: counts grow with a text, so the longest part that fits is
    found by doubling from a guess and halving the rest, without counting a long text over and over."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def _most(self, fits: Callable[[int], bool], most: int, guess: int) -> int:
        """The largest n up to ``most`` that fits, where 0 does and every smaller one than that."""
        low, high = 0, min(most, max(1, guess))
        while high < most and fits(high):
            low, high = high, min(most, 2 * high)
        if low < high and fits(high):
            return high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    def head(self, text: str, tokens: int) -> int:
        """Characters of the longest beginning within ``tokens``."""
        return self._most(lambda n: self.count(text[:n]) <= tokens, len(text), CHARS_PER_TOKEN * tokens)

    def tail(self, text: str, tokens: int) -> str:
        """The longest end of a text within ``tokens``."""
        if tokens <= 0:
            return ""
        n = self._most(lambda n: self.count(text[len(text) - n :]) <= tokens, len(text), CHARS_PER_TOKEN * tokens)
        return text[len(text) - n :]

    def split(self, text: str, tokens: int) -> list[tuple[str, int]]:
        """A text in pieces within ``tokens``, each as long as can be; a single character may be larger."""
        out, at = [], 0
        while at < len(text):
            # Only the part that the next piece may come from is looked at.
            room = 8 * CHARS_PER_TOKEN * max(2, tokens)
            while at + room < len(text) and self.count(text[at : at + room]) <= tokens:
                room *= 2
            part = text[at : at + room]
            piece = part[: max(1, self.head(part, tokens))]
            out.append((piece, self.count(piece)))
            at += len(piece)
        return out

    def shortened(self, text: str, room: int, least: int) -> str:
        """A text halved until it counts at most ``room``; nothing if that is below ``least`` tokens."""
        size = self.count(text)
        if size <= room:
            return text
        kept = text
        while kept and size > room:
            kept = kept[: len(kept) // 2]
            size = self.count(kept)
        return kept if size >= least else ""


class CharMeasure(Measure):
    """The estimate; ends and pieces follow from the length."""

    def __init__(self):
        super().__init__(lambda text: len(text) // CHARS_PER_TOKEN + 1)

    def tail(self, text: str, tokens: int) -> str:
        return text[-CHARS_PER_TOKEN * tokens :] if tokens > 0 else ""


class TokenCounter:
    """Estimate by characters; the Column form needs no Python worker."""

    name = "chars"
    is_fallback = True

    def column(self, text: Column | str) -> Column:
        return token_count(text)

    def measure(self) -> Measure:
        return CharMeasure()

    def get_info(self) -> dict:
        return {"model_name": self.name, "is_available": True, "is_fallback": self.is_fallback}


class ArrowTokenCounter(TokenCounter):
    """Counter backed by a user tokenizer.

    ``factory`` is called once per Python worker and returns an ``encode``
    callable.  A text the tokenizer rejects falls back to the estimate, unless
    ``strict`` is set.
    """

    is_fallback = False

    def __init__(self, name: str, factory: Callable[[], Callable], strict: bool = False):
        self.name = name
        self._factory = factory
        self._strict = strict

    def measure(self) -> Measure:
        encode, strict = self._factory(), self._strict

        def count(text: str) -> int:
            try:
                return len(encode(text))
            except Exception:
                if strict:
                    raise
                return len(text) // CHARS_PER_TOKEN + 1

        return Measure(count)

    def _udf(self, kind: str, one: Callable, *columns: Column) -> Column:
        """``one(measure, value, ...)`` per row, by Arrow batches; nulls stay null."""
        measure, held = self.measure, []

        @F.arrow_udf(kind)
        def run(*arrays: pa.Array) -> pa.Array:
            if not held:
                held.append(measure())
            rows = zip(*(a.to_pylist() for a in arrays))
            return pa.array([None if None in row else one(held[0], *row) for row in rows], arrow_type)

        arrow_type = {"int": pa.int32(), "string": pa.string(), SIZED: _SIZED}[kind]
        return run(*columns)

    def column(self, text: Column | str) -> Column:
        return self._udf("int", lambda m, s: m.count(s), col(text))

    def tail_column(self, text: Column | str, tokens: int) -> Column:
        """The longest end of a text within ``tokens``."""
        return self._udf("string", lambda m, s: m.tail(s, tokens), col(text))

    def sized(self, items: Column | str, cap: int) -> Column:
        """The size of each string of an array, and the pieces of those over ``cap``."""

        def one(m, texts):
            out = []
            for s in texts:
                k = m.count(s)
                parts = [{"text": t, "token_count": n} for t, n in m.split(s, cap)] if k > cap else None
                out.append({"k": k, "parts": parts})
            return out

        return self._udf(SIZED, one, col(items))


SIZED = "array<struct<k:int,parts:array<struct<text:string,token_count:int>>>>"
_PIECE = pa.struct([("text", pa.string()), ("token_count", pa.int32())])
_SIZED = pa.list_(pa.struct([("k", pa.int32()), ("parts", pa.list_(_PIECE))]))


def exact(counter: TokenCounter | None) -> ArrowTokenCounter | None:
    """The counter if it counts by a tokenizer, so that the estimate can stay inside the JVM."""
    return counter if isinstance(counter, ArrowTokenCounter) else None
