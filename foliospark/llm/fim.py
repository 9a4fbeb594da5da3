"""Fill-in-the-middle samples: cuts between tokens by a learned rank index.

A token is a word with the white space before it, or the white space that ends a text.  A document's random numbers come
from a hash of its id, so reruns agree.  Two of them name token ranks, where prefix and middle end.  The index answers
where a rank lies: straight pieces are fitted to all token boundaries of the text so that none is further than ``ERROR``
bytes from its piece, a cut is predicted from its piece, and the stored residual, one byte a boundary, corrects it
exactly.  Only the index needs Python; hashes, forms, samples and their restoration are column expressions.

Null and empty texts have no tokens and the form plain.  A null id is hashed as an empty one.  Repeated rows give equal
samples.  White space alone is one token.  A very long text costs a few bytes a character and one index.  All columns of
the input travel in the struct ``row``, so none can clash.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import text_or_empty

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes between a boundary and its piece, at most; with rounding, a residual fits in one byte.
ERROR = 100
FIRST_SPAN = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def boundaries(data: bytes) -> np.ndarray:
    """Byte offsets of rank 0 (the start) to rank n (the end of the last of n tokens)."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    if not len(space):
        return np.zeros(1, np.int64)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], ends, [len(space)])).astype(np.int64)


class RankIndex:
    """Rank to offset in straight pieces with an error bound, and the residuals that make them exact."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 <= error < 127:
            raise ValueError("a residual must fit in one byte")
        pieces = []
        at = 0
        while at < len(offsets):
            stop, slope = _piece(offsets, at, error)
            pieces.append((at, offsets[at], slope))
            at = stop
        first, base, slope = zip(*pieces)
        self.first, self.base, self.slope = np.array(first), np.array(base), np.array(slope, float)
        self.residual = (offsets - self._predicted(np.arange(len(offsets)))).astype(np.int8)

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[piece] + np.rint(self.slope[piece] * (ranks - self.first[piece])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self._predicted(ranks) + self.residual[ranks]


def _piece(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """End and slope of the longest line from boundary ``at`` that passes within ``error`` of every boundary before the end.

    Each boundary allows a range of slopes; their intersection narrows until it is empty."""
    low, high, stop, span = -np.inf, np.inf, at + 1, FIRST_SPAN
    while stop < len(offsets):
        ranks = np.arange(stop, min(stop + span, len(offsets)))
        run, rise = ranks - at, offsets[ranks] - offsets[at]
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        empty = lows > highs
        fits = int(empty.argmax()) if empty.any() else len(ranks)
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        stop += fits
        if fits < len(ranks):
            break
        span *= 2
    return stop, 0.0 if stop == at + 1 else (low + high) / 2


def cut(data: bytes, first: int, second: int) -> tuple[int, int, int]:
    """Tokens of a text, and the code points of prefix and middle when two draws are reduced to token ranks."""
    index = RankIndex(boundaries(data))
    n = len(index.residual) - 1
    ends = index.offsets(np.sort(np.array([first, second]) % (n + 1)))
    starts_character = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return n, int(starts_character[: ends[0]].sum()), int(starts_character[ends[0] : ends[1]].sum())


_CUT = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


@F.arrow_udf(StructType([StructField(f.name, LongType()) for f in _CUT]))
def _cuts(data: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(data, first.to_pylist(), second.to_pylist()):
        text = text.as_py()
        out.append((len(boundaries(text)) - 1, None, None) if a is None else cut(text, a, b))
    return pa.array([dict(zip(_CUT.names, x)) for x in out], _CUT)


def _draws(id_col: str, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED,
) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): the sample of every document beside its whole row.

    ``output`` is the text (form plain), ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).
    Texts that hold a mark of their own stay plain, so every sample can be restored."""
    text = text_or_empty(text_col)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), marked.alias("marked"), _draws(id_col, seed).alias("h"))
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h")[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("row", "text", form.alias("form"), "h")
    draw = [F.when(F.col("form") != "plain", F.col("h")[i]) for i in range(2)]
    rows = rows.select("row", "text", "form", _cuts(F.col("text").cast("binary"), *draw).alias("cut"))
    rows = rows.select("row", "text", "form", "cut.*")
    first, second = F.col("prefix_chars"), F.col("prefix_chars") + F.col("middle_chars")
    part = {
        PREFIX: F.substring("text", F.lit(1), first.cast("int")),
        MIDDLE: F.substring("text", (first + 1).cast("int"), F.col("middle_chars").cast("int")),
        SUFFIX: F.substring("text", (second + 1).cast("int"), F.lit(2**31 - 1)),
    }

    def sample(*marks: str) -> Column:
        return F.concat(*(x for m in marks for x in (F.lit(m), part[m])))

    output = (
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", sample(PREFIX, SUFFIX, MIDDLE))
        .otherwise(sample(SUFFIX, PREFIX, MIDDLE))
    )
    return rows.select("row", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of a sample, from the sample and its form alone."""

    def parts(marks: str) -> Column:
        return F.split(F.substring(output, F.lit(len(PREFIX) + 1), F.lit(2**31 - 1)), marks, -1)

    psm, spm = parts(f"{SUFFIX}|{MIDDLE}"), parts(f"{PREFIX}|{MIDDLE}")
    return (
        F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
        .otherwise(F.concat(spm[1], spm[2], spm[0]))
    )


def digests(docs: DataFrame) -> DataFrame:
    """The report of the registered query: counts, and the digests of samples and of what is restored from them."""
    samples = fill_in_middle(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return samples.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
