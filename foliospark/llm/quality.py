"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio.

Words are runs without ASCII white space.  Unigrams and bigrams of a document are hashed into ``BUCKETS`` buckets.  Two
multinomials over the buckets are counted in one job: the raw corpus (every document) and the trusted target (documents
labelled good).  A document's score is the mean over its n-grams of log p_target - log p_raw; both are smoothed by
``PRIOR`` target counts, so n-grams that were hardly seen say nothing.  Every document is compared with one threshold.

Labels meet the documents in an ordinary join, so every labelled document counts.  They also set the threshold: the
largest that keeps at least ``KEEP_TRUSTED`` of the trusted documents and is no higher than needed for the labelled poor
ones (see ``threshold_of``).  All counts and quantiles cover all documents; only bucket counts and the scores next to a
quantile come to the driver.

Null and empty texts have no words and fail the base rules.  Without labels every score is 0 and the base rules decide.
Repeated rows are separate documents with equal results.  The words of a very long text are held by one task.  ``keep_good``
keeps the columns of its input, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import text_or_empty

BUCKETS = 1 << 16
PRIOR = 10.0
KEEP_TRUSTED = 0.998
RANK_ACCURACY = 100_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of the unigrams, then of the bigrams."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    first = h * np.uint64(0x9E3779B97F4A7C15)
    second = (first[:-1] ^ (h[1:] + np.uint64(0x7F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([first, second]) >> np.uint64(64 - int(math.log2(BUCKETS)))


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice, its first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    inside = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if (j := seen.setdefault(w, i)) != i:
            inside[j : j + 3] = inside[i : i + 3] = True
    return int(inside.sum())


def base_features(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    chars = sum(map(len, words)) if data.isascii() else len(b"".join(words).decode())
    symbols = sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() for x in batch.column("data"))


def _bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: n-grams of all (doc_id, data) rows, summed per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data in _texts(batch):
                if words := data.split():
                    b = np.bincount(ngram_buckets(words).astype(np.int64), minlength=0)
                    total[: len(b)] += b
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return docs.mapInArrow(count, "bucket long, n long")


def count_ngrams(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all (doc_id, data) rows, and of those whose id is in ``trusted``."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).hint("shuffle_hash")  # one plan for all sizes, texts unsorted
    good = docs.join(ids, F.col("doc_id").cast("long") == F.col("trusted_id"), "left_semi")
    both = _bucket_counts(docs).withColumn("good", F.lit(False)).unionByName(_bucket_counts(good).withColumn("good", F.lit(True)))
    rows = both.groupBy("bucket", "good").agg(F.sum("n").alias("n")).toPandas()  # 2 * BUCKETS rows at most
    out = np.zeros((2, BUCKETS))
    out[rows["good"].to_numpy(int), rows["bucket"]] = rows["n"]
    return out[0], out[1]


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, drawn to 0 where little was counted."""
    if good.sum() == 0:
        return np.zeros(BUCKETS)
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + PRIOR) / (expected + PRIOR))


def _score(data: bytes, ratio: np.ndarray) -> tuple:
    """n_words to n_repeat_words, then the score."""
    words = data.split()
    return *base_features(data, words), float(ratio[ngram_buckets(words)].mean()) if words else 0.0


def _fails_base(row: tuple) -> bool:
    return row[0] < MIN_WORDS or 100 * row[4] > MAX_REPEAT_PERCENT * row[0]


def score_documents(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base features, base_failed and score of every (doc_id, data) row."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_score(x, table.value) for x in _texts(batch)]
            columns = [*(list(zip(*rows)) or [()] * 6), [_fails_base(r) for r in rows]]
            types = [*[pa.int64()] * 5, pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, ", ".join([f"doc_id {kind}", *(f"{n} long" for n in names[1:6]), "score double, base_failed boolean"]))


def quantile(scores: DataFrame, q: float) -> float | None:
    """Quantile of ``score`` between its two nearest ranks; a sketch says which few scores around them to collect."""
    n = scores.count()
    if not n:
        return None
    margin = 2 / RANK_ACCURACY + 2 / n
    low, high = scores.agg(F.percentile_approx("score", [max(0.0, q - margin), min(1.0, q + margin)], RANK_ACCURACY)).first()[0]
    below = scores.filter(F.col("score") < low).count()
    near = scores.filter(F.col("score").between(low, high)).groupBy("score").count().orderBy("score").toPandas()
    upto, at = below + near["count"].cumsum().to_numpy(), (n - 1) * q
    first, second = (near["score"].iloc[int(np.searchsorted(upto, r, side="right"))] for r in (math.floor(at), math.ceil(at)))
    return float(first + (second - first) * (at - math.floor(at)))


def threshold_of(seen: DataFrame) -> float:
    """The cut between labelled scores (score, good, poor): half-way between the poor documents' 99 % quantile and the
    trusted ones' lowest ``1 - KEEP_TRUSTED``, but never above the latter."""
    low = quantile(seen.filter("good"), 1 - KEEP_TRUSTED)
    if low is None:
        return -math.inf
    high = quantile(seen.filter("poor"), 0.99)
    return low if high is None else min(low, (low + high) / 2)


def flags_of(labels: DataFrame) -> DataFrame:
    """doc_id, good, poor: a row for each labelled id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    flag = {name: F.max(F.col("quality") == value).alias(name) for name, value in (("good", 1), ("poor", 0))}
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flag.values())


def fit(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, DataFrame]:
    """Log ratios per bucket, the threshold and the scored documents, for (doc_id, data) rows."""
    flags = flags_of(labels)
    ratio = log_ratio(*count_ngrams(rows, flags.filter("good")))
    scored = durable(score_documents(rows, ratio), "quality-scores")
    lowest = scored.filter("not base_failed").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("score").alias("score"))
    return ratio, threshold_of(durable(lowest.join(flags, "doc_id"), "quality-labelled")), scored


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base features, base_failed, score and kept."""
    _, threshold, scored = fit(_rows(docs, id_col, text_col), labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject; all its columns."""
    ratio, threshold, _ = fit(_rows(docs, id_col, text_col), labels)
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_score((x.as_py() or "").encode(), table.value) for x in batch.column(text_col)]
            yield batch.filter(pa.array([not _fails_base(r) and r[5] >= threshold for r in rows], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
