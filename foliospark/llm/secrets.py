"""Secret scan: base patterns, and random strings told apart from identifiers by character Markov models.

Base kinds are regular expressions.  Besides, every other run of ``LEAST`` or more candidate characters, or what base spans
leave of one, is compared under two first-order Markov chains over characters, one of random strings and one of ordinary
words.  Their log-likelihood ratio decides: its mean a step must pass a threshold and its sum ``LEAST_SUM``, more for runs under
``SURE`` characters, of which there are many.  Steps to or from a separator say nothing, so paths and dates are judged by
their parts.

The chains are trained from labelled samples of the corpus itself.  What the base patterns matched is labelled random; as
this is mostly hexadecimal, the chain gives a part ``EVEN`` of its weight to even chances.  Words found in ``RECURS`` different
texts among ``MAX_SAMPLE_DOCS`` documents (in hash order of their ids) are labelled ordinary: random strings do not recur.
Each sample is bounded by ``MAX_SAMPLE`` strings in hash order; the chains have ``len(ALPHABET) + 1`` squared steps.

Everything is DataFrame expressions.  A span's position is the summed length of the pieces between matches, in code
points; running sums go over blocks of about the square root of their number, so texts with very many matches stay cheap.

Null and empty texts have no spans.  Repeated rows are scanned each.  A corpus without base matches gives no random
sample and so no added spans.  Input columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import text_or_empty

#: Fixed patterns of the base kinds, with the least length that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST, SURE = 16, 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SEPARATORS = "+/_-"
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z][A-Za-z0-9_]{3,18}(?![A-Za-z0-9+/_-])"
RECURS = 3
MAX_SAMPLE = 50_000
MAX_SAMPLE_DOCS = 2_000
BACKOFF = 5.0
EVEN = 0.75
#: Nats: a step; for the whole run; and more for each character under SURE.
THRESHOLD, LEAST_SUM, SHORT_SUM = 0.25, 4.75, 0.75


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each element, the sum of those before it."""
    n = F.size(lengths)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), (n / width).cast("int")), lambda k: _total(F.slice(lengths, k * width + 1, width)))
    parts = F.struct(lengths.alias("each"), blocks.alias("blocks"), width.alias("width"))
    # One struct, made once per row, that the element function reads from.
    return F.flatten(
        F.transform(
            F.array(parts),
            lambda p: F.transform(
                p["each"],
                lambda x, i: _total(F.slice(p["blocks"], 1, (i / p["width"]).cast("int")))
                + _total(F.slice(p["each"], (i / p["width"]).cast("int") * p["width"] + 1, i % p["width"])),
            ),
        )
    )


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, or an empty array."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    steps = F.filter(steps, lambda s: s["value"].isNotNull())

    def placed(s: Column) -> Column:
        return F.zip_with(
            s,
            _before(F.transform(s, lambda x: x["gap"] + x["len"])),
            lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["value"].alias("value")),
        )

    inner = F.flatten(F.transform(F.array(steps), placed))
    return F.when(text.rlike(pattern), inner).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with assign, access, hex: the spans of each base kind."""
    text = text_or_empty(text_col)
    assign = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_LEAST)
    return docs.withColumns({"assign": assign, "access": spans(text, ACCESS), "hex": spans(text, HEX)})


def _sample(strings: DataFrame) -> DataFrame:
    """At most MAX_SAMPLE distinct strings in hash order."""
    return strings.filter(F.length("value") > 1).distinct().orderBy(F.xxhash64("value"), "value").limit(MAX_SAMPLE)


def _step_codes(value: Column) -> Column:
    """Codes of neighbouring character pairs; 0 stands for characters outside ALPHABET."""
    m = len(ALPHABET) + 1
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.slice(codes, 1, F.length(value) - 1), F.slice(codes, 2, F.length(value) - 1), lambda a, b: a * m + b)


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratio of every step (random over ordinary).  An ordinary step seen rarely leans on how common its
    second character is, a random one on even chances.  Zero for steps to or from a separator, and without both samples."""
    import math

    m = len(ALPHABET) + 1
    labelled = random.select("value", F.lit(1).alias("kind")).unionByName(ordinary.select("value", F.lit(0).alias("kind")))
    counted = labelled.select("kind", F.explode(_step_codes(F.col("value"))).alias("step")).groupBy("kind", "step").count()
    counts = [[0] * (m * m) for _ in range(2)]
    for r in counted.collect():  # 2 * m * m rows at most
        counts[r["kind"]][r["step"]] = r["count"]
    if not all(map(sum, counts)):
        return [0.0] * (m * m)
    rows = [[sum(c[a * m : (a + 1) * m]) for a in range(m)] for c in counts]
    alone = [sum(counts[0][b::m]) + 0.5 for b in range(m)]
    silent = {0, *(ALPHABET.index(c) + 1 for c in SEPARATORS)}

    def ratio(a: int, b: int) -> float:
        if a in silent or b in silent:
            return 0.0
        learned = (counts[1][a * m + b] + BACKOFF / m) / (rows[1][a] + BACKOFF)
        plain = (counts[0][a * m + b] + BACKOFF * alone[b] / sum(alone)) / (rows[0][a] + BACKOFF)
        return math.log(EVEN / m + (1 - EVEN) * learned) - math.log(plain)

    return [ratio(a, b) for a in range(m) for b in range(m)]


def sum_of_ratios(value: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string, summed over its steps."""
    import json

    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # a constant of fixed size
    return F.aggregate(_step_codes(value), F.lit(0.0), lambda a, s: a + F.get(table, s))


def is_random(value: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    n = F.length(value)
    least = F.lit(LEAST_SUM) + F.lit(SHORT_SUM) * F.greatest(F.lit(0), F.lit(SURE) - n)
    return sum_of_ratios(value, ratios) > F.greatest(least, F.lit(threshold) * (n - 1))


def free_pieces(candidates: Column, base: Column) -> Column:
    """What the base spans leave of the candidates, in pieces of at least LEAST characters."""

    def pieces(c: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

        def cut(spans_met: Column) -> Column:
            starts = F.array_distinct(F.concat(F.array(c["start"]), F.transform(spans_met, lambda b: b["end"])))
            starts = F.filter(starts, lambda s: ~F.exists(spans_met, lambda b: (b["start"] <= s) & (s < b["end"])))
            ends = lambda s: F.least(c["end"], F.array_min(F.transform(F.filter(spans_met, lambda b: b["start"] >= s), lambda b: b["start"])))
            found = F.transform(starts, lambda s: F.struct(s.alias("start"), ends(s).alias("end")))
            found = F.filter(found, lambda x: x["end"] - x["start"] >= LEAST)
            part = lambda x: F.substring(c["value"], x["start"] - c["start"] + 1, x["end"] - x["start"])
            return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), part(x).alias("value")))

        return F.flatten(F.transform(F.array(met), cut))

    return F.flatten(F.transform(candidates, pieces))


def _texts_of(kinds: tuple[str, ...]) -> Column:
    """The spans of these columns as sorted ``kind:start:end``, comma-joined."""

    def keyed(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))

    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*map(keyed, kinds))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    named = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = base_spans(named).withColumn("candidates", spans(F.col("text"), CANDIDATE))
    base = F.concat(*BASE)
    free = free_pieces(F.col("candidates"), base)
    found = durable(found.select("doc_id", *BASE, free.alias("candidates")), "secret-spans")

    secret = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 1)), F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]))
    random = _sample(found.filter(F.size(base) > 0).select(F.explode(secret).alias("value")))
    ids = named.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE_DOCS)
    bare = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = F.array_distinct(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0)))
    plain = named.join(F.broadcast(ids), "doc_id").select("text", F.explode(words).alias("value"))
    texts = F.count_distinct(F.xxhash64("text"))
    plain = plain.groupBy("value").agg(texts.alias("texts")).filter(F.col("texts") >= RECURS).select("value")
    ratios = train(random, _sample(plain))

    markov = F.filter("candidates", lambda c: is_random(c["value"], ratios, threshold))
    judged = found.withColumn("markov", markov)
    return judged.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_texts_of(BASE), 256).alias("base_sha256"),
        _texts_of(KINDS).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
