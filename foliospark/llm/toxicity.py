"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: whole words and word beginnings (invented inflections share a stem) that occur almost only in
documents labelled toxic.  Features are densities of lexicon words, of lexicon words near a second person, and of lexicon
words that appear only once disguises such as ``1d10t`` or ``i.d.i.o.t`` are undone, besides capitals, punctuation, marks
of emphasis and word shape.  Spark's GBT classifier is fitted on part of the training rows, isotonic regression on the
rest turns its probability into a calibrated score.

Learning sees only rows with a label whose crc32(id as text) mod 4 is not ``HELD_OUT``.  A third of them, by a hash of the
id, is for the calibration alone: neither the lexicon nor the trees see it, so that its features are like those of new
documents.  The lexicon is counted over all others; every entry over the bounds on support and precision is kept.  The
support is at least a ``SUPPORT_SHARE``-th of the toxic documents, so the lexicon does not grow with the corpus.  Trees and
calibration see at most ``MAX_TRAIN`` rows in hash order; label, language, source and id are no features.  Every document
is scored by its whole text.

Null and empty texts have all features zero and get a score like any other.  Rows that repeat an id are scored each; of
contradicting labels the larger counts.  With no labels, or labels of one kind only, the score is that share (0 if none).
Input columns other than id and text are not read, so none can clash.  An empty table of documents gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import text_or_empty

HELD_OUT = 2
THRESHOLD = 0.3
MAX_TRAIN = 20_000
MIN_TOXIC_DOCS = 4
SUPPORT_SHARE = 2_000
MIN_PRECISION = 0.9
PREFIXES = range(3, 9)
CACHE_WORDS = 500_000
FLUSH_KEYS = 400_000
#: Second person in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti tus tú usted ustedes vos toi ton ta tes vous votre".split())
DISGUISES = str.maketrans("013457@$!", "oieastasi")
WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"\S*[\d@$!*._\-]\S*")
SPACED = re.compile(r"\b(?:\w[ ._\-*]){3,}\w\b")
FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_kinds", "near_person", "person_density", "disguised", "capitals", "all_caps",
    "punctuation", "exclamations", "symbols", "digits", "word_length", "variety", "length",
)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def stems(word: str) -> list[str]:
    """The word marked as whole, and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if n <= len(word))]


class Lexicon:
    """Words that equal an entry ``=word`` or begin with an entry."""

    def __init__(self, entries):
        self.entries, self.known = frozenset(entries), {}

    def has(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            hit = self.known[word] = any(s in self.entries for s in stems(word))
        return hit


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(FEATURES)
    low = text.lower()
    words = WORDS.findall(low)
    n, has = max(1, len(words)), lexicon.has
    counts = Counter(words)
    kinds = [w for w in counts if has(w)]
    hits = sum(counts[w] for w in kinds)
    persons = sum(counts[w] for w in SECOND_PERSON if w in counts)
    near = 0
    if hits and persons:
        at = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        hit_at = np.array([i for i, w in enumerate(words) if has(w)])
        right = np.searchsorted(at, hit_at)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - hit_at), np.abs(at[np.maximum(right - 1, 0)] - hit_at))
        near = int((gap <= 4).sum())
    disguised = 0
    for t in TOKENS.findall(low):
        plain = re.sub(r"[^\w]|_", "", t.translate(DISGUISES))
        if plain and has(plain) and not any(has(w) for w in WORDS.findall(t)):
            disguised += 1
    for t in SPACED.findall(low):
        disguised += has(re.sub(r"[\W_]", "", t.translate(DISGUISES)))
    size = len(text)
    caps = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = 0 if caps < size / 50 else sum(w.isupper() and len(w) > 2 for w in WORDS.findall(text))
    marks = sum(map(text.count, ".,;:?!'\"()-"))
    symbols = sum(map(text.count, "#*$%&|<>@~^"))
    digits = sum(map(text.count, "0123456789"))
    return (
        hits / n, float(min(hits, 50)), float(min(len(kinds), 50)), near / n, persons / n, disguised / n, caps / size, shouted / n,
        marks / size, text.count("!") / n, symbols / n, digits / size, sum(map(len, words)) / n, len(counts) / n, float(np.log1p(size)),
    )


def usable_labels(labels: DataFrame) -> DataFrame:
    """All (doc_id, toxic) that may be learned from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def training_rows(labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` of the usable labels."""
    return usable_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def calibrates(id_col: str = "doc_id"):
    """Whether a labelled row is kept for the calibration."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(1)), F.lit(3)) == 0


def without_implied(found: DataFrame) -> DataFrame:
    """Entries whose words do not all begin with a shorter entry."""
    word = F.ltrim("entry", F.lit("="))
    longest = F.length(word) - F.when(F.startswith("entry", F.lit("=")), 0).otherwise(1)
    lengths = F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= longest)
    shorter = found.select("entry", F.explode(F.transform(lengths, lambda n: F.substring(word, F.lit(1), n))).alias("shorter"))
    implied = shorter.join(found.select(F.col("entry").alias("shorter")), "shorter", "left_semi").select("entry").distinct()
    return found.join(implied, "entry", "left_anti")


def learn_lexicon(texts: DataFrame, support: int = MIN_TOXIC_DOCS) -> list[str]:
    """Entries from (text, toxic) rows that ``support`` toxic texts hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen):
            keys = list(seen[0].keys() | seen[1].keys())
            numbers = [pa.array([c[k] for k in keys], pa.int64()) for c in seen]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *numbers], ["entry", "other", "toxic"])

        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic == 1].update({s for w in set(WORDS.findall(text.lower())) for s in stems(w)})
                if len(seen[0]) + len(seen[1]) > FLUSH_KEYS:
                    yield rows(seen)
                    seen = (Counter(), Counter())
        yield rows(seen)

    found = (
        texts.mapInArrow(count, "entry string, other long, toxic long")
        .groupBy("entry")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= support) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("other"))))
    )
    return sorted(r.entry for r in without_implied(durable(found, "toxicity-lexicon")).select("entry").collect())


def feature_rows(docs: DataFrame, lexicon: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon)
        for batch in batches:
            found = np.array([features(x.as_py(), words) for x in batch.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in found.T)], ["doc_id", *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FEATURES)]))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    train = durable(training_rows(labels), "toxicity-train")  # MAX_TRAIN rows, so fit to broadcast
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    usable = usable_labels(labels).filter(~calibrates())
    support = max(MIN_TOXIC_DOCS, (usable.agg(F.sum("toxic")).first()[0] or 0) // SUPPORT_SHARE)
    usable = usable.hint("shuffle_hash")  # one plan for all sizes, texts unsorted
    lexicon = learn_lexicon(named.join(usable, "doc_id").select("text", "toxic"), support)
    rows = durable(feature_rows(docs, lexicon, id_col, text_col), "toxicity-features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    known = rows.join(F.broadcast(train.withColumnRenamed("doc_id", "label_id")), F.col("doc_id").cast("long") == F.col("label_id"))
    known = known.select("vector", F.col("toxic").cast("double").alias("label"), calibrates("label_id").alias("calibrate"))
    known = durable(known, "toxicity-known")
    share = known.agg(F.avg("label").alias("p"), F.count_if("calibrate").alias("n"), F.countDistinct(F.when(~F.col("calibrate"), F.col("label"))).alias("k")).first()
    if share.p is None or share.k < 2 or not share.n:
        score = F.lit(float(share.p or 0.0))
        scored = rows.withColumn("score", score)
    else:
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxDepth=4, maxIter=20, stepSize=0.2, maxBins=64, seed=7)
        trees = trees.fit(known.filter(~F.col("calibrate")).coalesce(8))

        def raw(df):
            return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])

        fitted = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
            raw(known.filter("calibrate")).select("raw", "label")
        )
        scored = fitted.transform(raw(rows).select("doc_id", "raw"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )
