"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates
from ..functions.tokens import ArrowTokenCounter, token_count
from ..operators.chunk_text import chunk_text
from ..session import durable, fresh_path
from ..sources.documents import read_table, write_files
from ..sources.manifest import list_files

CS = 100
SAMPLE = 50
WORDS_CS = 40


def _words():
    import re

    return re.compile(r"[^\x20\x09-\x0D]+").findall


#: A counter of words, as an example of a tokenizer that SQL can follow.
WORDS = ArrowTokenCounter("words", _words, strict=True)


def documents(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", "doc_id", "text", *extra)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/pages.parquet", "page_id", "html").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )


def chunks(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return chunk_text(documents(spark, sf, *extra), CS)


def crlf_documents(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    text = (
        F.when(kind == 1, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(kind == 2, F.replace("text", F.lit("\n"), F.lit("\r")))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf).withColumn("text", text)


def _replaced(df: DataFrame, pairs) -> DataFrame:
    text = F.col("text")
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return df.withColumn("text", text)


# Rewrites that turn prose into code and into Markdown, the same in both engines.
CODE_REWRITES = (
    (". ", " }\ndef "), (", ", " {\n"), (" and ", ' " '), (" des ", " (\n"),
    (" le ", ")\n\n"), (" the ", "\n  class "), (" und ", "\n  x\n  y = "), (" de ", ";\n"),
    (" von ", "\nfrom import_x\n"), (" que ", "\nfrom x import y\n"),
)
MARKDOWN_REWRITES = (
    (". ", ".\n\n## "), (", ", ",\n- "), (" the ", "\n```\n"), (" la ", "\n---\n"), (" und ", "\n| "),
)


BROKEN_REWRITES = (
    (" de ", "-\n"), (", ", "\n 12 \nPage 7\n"), (" the ", " \t  "), (" und ", "■□ ????? "), (" la ", "\n \n\n"), (" ", "\n"),
)


def broken_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as a bad extraction leaves them."""
    return _replaced(documents(spark, sf), BROKEN_REWRITES)


def code_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _replaced(documents(spark, sf), CODE_REWRITES)


def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _replaced(documents(spark, sf), MARKDOWN_REWRITES)


def front_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a header of all kinds of values; every third one lacks two required fields."""
    d = F.col("doc_id").cast("string")
    full = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("\nid: D"), d, F.lit("\ndate: 2024-01-05"))).otherwise("")
    header = F.concat(
        F.lit("---\ntitle: T"), d, F.lit("\nauthor: "), F.col("source"), F.lit("\ntype: "), F.col("lang"),
        F.lit("\nn: "), d, F.lit("\nratio: 2.5\nnote: 'no'\nempty:\ndraft: "), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("false"),
        F.when(F.col("doc_id") % 4 == 0, "\ntags: [a, 7, {k: v}]").otherwise(""), full,
        F.lit("\n---\n"),
    )
    return documents(spark, sf, "source", "lang").select("doc_id", F.concat(header, "text").alias("text"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.element_at(F.array(*[F.lit(x) for x in ("a", "build", "c", ".git")]), (F.col("doc_id") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".log", ".txt")]), (F.col("doc_id") % 3 + 1).cast("int"))
    rel = F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), ext))
    table = read_table(spark, f"{sf}/documents.parquet", "doc_id", "source", "lang", "n_chars")
    return table.select(
        F.concat(F.lit("/in/"), rel).alias("path"), rel.alias("rel_path"), F.col("n_chars").alias("length"), "doc_id"
    )


def written_folder(spark: SparkSession, sf: str) -> str:
    """A folder with one file per document: hidden names, sub-folders and empty files among them."""
    folder = fresh_path(spark, "files")
    place = F.element_at(F.array(*[F.lit(x) for x in ("", "a/", "_b/", ".c/d/")]), (F.col("doc_id") % 4 + 1).cast("int"))
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "_", ".")]), (F.col("doc_id") % 3 + 1).cast("int"))
    ext = F.when(F.col("doc_id") % 5 == 0, ".log").otherwise(".md")
    docs = documents(spark, sf).select(
        F.concat(F.lit(folder + "/"), place, start, F.col("doc_id").cast("string"), ext).alias("output_path"),
        F.when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("text")).alias("output_text"),
    )
    durable(write_files(docs), "files-status")
    return folder


def written_files(spark: SparkSession, sf: str) -> DataFrame:
    return list_files(spark, written_folder(spark, sf))


def wrapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``elements``: each line of a document, escaped, as one XML element."""
    line = F.split("text", "\n", -1)
    esc = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return documents(spark, sf).select(
        "doc_id",
        F.transform(line, lambda s: F.concat(F.lit("<p>"), esc(s), F.lit("</p>"))).alias("elements"),
    )


def responses(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """A stored response table: every 7th chunk failed, every 11th came back empty."""
    n = F.col("chunk_index") + 1
    error = F.when(n % 7 == 0, F.lit("server error: simulated")).when(
        n % 11 == 0, F.lit("server error: the model sent no text")
    )
    ok = F.col("error").isNull()
    answer = F.when(ok, F.concat(F.lit("> "), F.col("text")))
    return (
        chunks(spark, sf, *extra)
        .withColumn("error", error)
        .withColumn("response", answer)
        .select(
            "doc_id", *extra, "chunk_index", "n_chunks", "text", "token_count",
            "response", "error",
            F.when(ok, token_count("response")).alias("response_tokens"),
            F.when(ok, F.length("response")).alias("response_chars"),
            (F.col("token_count") + 10).alias("total_input_tokens"),
            F.when(F.col("chunk_index") % 5 == 0, "fallback1").otherwise("primary").alias("model"),
            (F.col("token_count") * F.lit(0.25)).alias("seconds"),
        )
    )


def utc(spark: SparkSession) -> None:
    """The event table holds UTC times without a zone: read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the headers of their answers, from the event table."""
    utc(spark)
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    headers = F.create_map(
        F.lit(rates.H_LIMIT_TOKENS), F.lit("400000"),
        F.lit(rates.H_LIMIT_REQUESTS), F.lit("1000"),
        F.lit(rates.H_LEFT_TOKENS), F.when(e % 13 == 0, "invalid").otherwise(text(e * 7919 % 120000)),
        F.lit(rates.H_LEFT_REQUESTS), text(e * 31 % 300),
        F.lit(rates.H_RESET_TOKENS), F.when(e % 19 == 0, "soon").otherwise(F.concat(text(e % 60), F.lit(".5"))),
    )
    none = F.create_map().cast("map<string,string>")
    return read_table(spark, f"{sf}/events.parquet", "event_id", "ts", "user_id", "event_type", "value").select(
        F.col("user_id").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tokens"),
        "event_type",
        F.when(e % 17 == 0, none).otherwise(headers).alias("headers"),
    )


def rate_log(spark: SparkSession, sf: str) -> DataFrame:
    return request_log(spark, sf).withColumn("status", rates.parse_rate_headers("headers", "ts")).drop("headers")
