"""Repairs of extracted text: rules that need no model.

The rules on one text are expressions.  Repeated lines (headers, footers, licence lines) are found over all documents of a
group, such as a source.  Their counts combine map-side, and a line that very many documents share is spread over
``SALTS`` keys when it is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: What stands for characters that were lost, and what a page number may look like.
GARBLE = r"[■□▪▫\x{FFFD}]+|\?{4,}"
PAGE_NUMBER = r"^[ \t]*(?:[Pp]age|[Ss]eite|[Pp]ágina)?[ \t]*-?[ \t]*[0-9]{1,4}[ \t]*-?[ \t\r]*$"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dehyphenate(text: Column | str) -> Column:
    """Join words that were divided at the end of a line."""
    return F.regexp_replace(_text(text), r"(\p{L})-\n[ \t\r\n]*(\p{Ll})", "$1$2")


def clean_spacing(text: Column | str) -> Column:
    """One blank between words, at most one empty line between paragraphs."""
    return F.regexp_replace(F.regexp_replace(_text(text), r"[ \t]+", " "), r"\n ?(?:\n ?)+", "\n\n")


def drop_page_numbers(text: Column | str) -> Column:
    """Leave out lines with nothing but a page number."""
    return F.array_join(F.filter(F.split(_text(text), "\n", -1), lambda s: ~s.rlike(PAGE_NUMBER)), "\n")


def drop_garble(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), GARBLE, "")


def merge_lines(text: Column | str) -> Column:
    """Join a line that does not end a sentence with the next one, if that starts with a letter."""
    return F.regexp_replace(_text(text), r"(?<=[^.!?:;\n])\n(?=\p{L})", " ")


def _lines(text: str) -> Column:
    """Digests of the lines of a text that are not blank, each once."""
    full = F.filter(F.split(text, "\n", -1), lambda s: F.trim(s) != "")
    return F.array_distinct(F.transform(full, F.md5))


def repeated_lines(docs: DataFrame, by: str, least_docs: int, percent: int, text: str = "text") -> DataFrame:
    """(by, line_id, n_docs) of the lines in at least ``least_docs`` documents and ``percent`` of those of their group."""
    lines = docs.select(F.col(by).alias("g"), F.explode(_lines(text)).alias("line_id"))
    counts = lines.groupBy("g", "line_id").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    sizes = docs.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("size"))
    common = counts.join(sizes, F.col("g").eqNullSafe(F.col("of"))).filter(100 * F.col("n_docs") >= percent * F.col("size"))
    return common.select(F.col("g").alias(by), "line_id", "n_docs")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", by: str = "source", least_docs: int = 5, percent: int = 5, text: str = "text"
) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`; ``n_dropped`` counts those left out.

    Only digests travel: each document's repeated lines are gathered under its key, and the text is cut in its own row."""
    common = repeated_lines(docs, by, least_docs, percent, text)
    common = common.select(F.col(by).alias("g"), F.col("line_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    here = docs.select(F.col(key).alias("k"), F.col(by).alias("b"), salt.alias("salt"), F.explode(_lines(text)).alias("line_id"))
    same = (here.line_id == common.id) & (here.salt == common.s) & here.b.eqNullSafe(common.g)
    found = here.join(common, same, "left_semi").groupBy("k", "b").agg(F.collect_set("line_id").alias("_found"))
    joined = docs.join(found, docs[key].eqNullSafe(found.k) & docs[by].eqNullSafe(found.b), "left").drop("k", "b")
    every = F.split(text, "\n", -1)
    kept = F.filter(every, lambda s: ~F.coalesce(F.array_contains("_found", F.md5(s)), F.lit(False)))
    return joined.withColumns({
        "n_dropped": F.coalesce(F.size(every) - F.size(kept), F.lit(0)).cast("bigint"),
        text: F.when(F.col("_found").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).drop("_found")
