"""Document metadata: frontmatter, completeness, prompt context."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REQUIRED_FIELDS
from .text import strip
from .tokens import col, let

# Fence of a frontmatter block, prompt texts, prompt size limit.
FENCE = r"(?md)^-{3,}\s*$"
CONTEXT_HEAD = "Our current input text chunk is part of the document "
EXPLAIN_SYSTEM = "You catalogue documents.  Answer with one JSON object and nothing else."
EXPLAIN_TASK = "Some fields of this record are empty.  Complete them from the excerpt.\n\nRecord: "
EXPLAIN_CHUNK = "\n\nExcerpt: "
EXPLAIN_END = "\n"
EXPLAIN_CHARS = 4_000
METADATA_SCHEMA = ", ".join(f"{name} string" for name in REQUIRED_FIELDS)

# A header of plain "key: scalar" lines needs no YAML parser.
FLAT_LINE = r"""[A-Za-z_][\w .-]*:(?:[ \t]+(?:"[^"\\]*"|'[^']*'|[^\s\[\]{}&*!|>'"#%@`,?:-][^#\n]*?)?)?[ \t]*"""
FLAT_HEADER = rf"\A\s*(?:{FLAT_LINE}(?:\n\s*|\z))*\z"
NULLS = ("", "~", "null", "Null", "NULL")
TRUE = ("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON")
FALSE = ("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF")
INT, FLOAT, DATE = "-?(?:0|[1-9][0-9]*)", "-?(?:0|[1-9][0-9]{0,6})\\.(?:0|[0-9]{0,3}[1-9])", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
SIMPLE = f"(?:{INT}|{FLOAT}|{DATE})"
# Numbers and times in other notations than SIMPLE are left to the YAML parser.
ODD_LINE = (
    rf"(?m)^[^:\n]*:[ \t]+(?!{SIMPLE}[ \t]*$)"
    r"(?:[+.]?[0-9][0-9_.:a-fA-FxXoO+-]*|\.(?:inf|Inf|INF|nan|NaN|NAN)|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[Tt \t][^\n]*)[ \t]*$"
)


def json_string(text: Column) -> Column:
    """A string as JSON."""
    return let(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - F.lit(2)))


def _header_parts(text: Column) -> Column:
    """struct<present, header, body, plain>, with one scan of the stripped text.

    Only a text that starts with a fence is searched for the closing one.
    """

    def split(t):
        return let(
            F.when(t.startswith("---"), F.split(t, FENCE, 3)),
            lambda p: F.struct(
                F.coalesce((F.size(p) == 3) & (F.get(p, F.lit(0)) == ""), F.lit(False)).alias("present"),
                F.get(p, F.lit(1)).alias("header"),
                strip(F.get(p, F.lit(2))).alias("body"),
                t.alias("plain"),
            ),
        )

    return let(strip(text), split)


def has_frontmatter(text: Column | str) -> Column:
    return _header_parts(col(text))["present"]


def _flat_map(header: Column) -> Column:
    lines = F.filter(F.split(header, "\n", -1), lambda s: s.contains(":"))

    def value(s):
        raw = F.trim(F.regexp_replace(s, r"^[^:]*:", ""))
        quoted = raw.rlike(r"""^(?:"[^"]*"|'[^']*')$""")
        return (
            F.when(quoted, json_string(F.substring(raw, F.lit(2), F.length(raw) - F.lit(2))))
            .when(raw.isin(*NULLS), F.lit("null"))
            .when(raw.isin(*TRUE), F.lit("true"))
            .when(raw.isin(*FALSE), F.lit("false"))
            .when(raw.rlike(f"^{SIMPLE}$"), raw)
            .otherwise(json_string(raw))
        )

    keys = F.transform(lines, lambda s: F.trim(F.substring_index(s, ":", 1)))
    return F.map_from_arrays(keys, F.transform(lines, value))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def yaml_map(header: pd.Series) -> pd.Series:
    """Nested or unusual headers."""
    import datetime

    import yaml

    def text(v):
        if type(v) is datetime.date:
            return v.isoformat()
        return json.dumps(v, separators=(",", ":"), default=str, ensure_ascii=False)

    def one(h):
        try:
            parsed = yaml.safe_load(h)
        except (yaml.YAMLError, ValueError):
            return None
        if not isinstance(parsed, dict):
            return {}
        return {str(k): text(v) for k, v in parsed.items()}

    return header.map(one, na_action="ignore")


def with_frontmatter(df: DataFrame, quirks: str = "fixed", nested: bool = True) -> DataFrame:
    """Replace ``text`` by its body and add ``metadata map<string,string>``.

    A value keeps its type: it is the JSON of what the header says, save that a date is bare (``2024-01-05``), so that
    it differs from a quoted one.

    A header that cannot be parsed leaves the whole text as body.  With
    ``quirks='reference'`` an empty body also falls back to the whole text.  Flat
    headers are parsed in the JVM; only other headers (never texts) go to Python,
    and none do with ``nested=False``.
    """
    df = df.withColumn("_p", _header_parts(F.col("text")))
    header = F.col("_p.header")
    df = df.withColumn("_flat", F.coalesce(header.rlike(FLAT_HEADER) & ~header.rlike(ODD_LINE), F.lit(False)))
    other = F.when(F.col("_p.present") & ~F.col("_flat"), header)
    empty = F.create_map().cast("map<string,string>")
    parsed = yaml_map(other) if nested else F.when(other.isNotNull(), empty)
    df = df.withColumn("_found", parsed).withColumn(
        "_found", F.when(F.col("_flat"), _flat_map(header)).otherwise(F.col("_found"))
    )
    body, plain = F.col("_p.body"), F.col("_p.plain")
    if quirks == "reference":
        body = F.when(body == "", F.col("text")).otherwise(body)
    text = (
        F.when(F.col("_found").isNotNull(), body)
        .when(F.col("_p.present") | (plain == ""), F.col("text"))
        .otherwise(plain)
    )
    return (
        df.withColumn("metadata", F.coalesce("_found", empty))
        .withColumn("text", text)
        .drop("_p", "_flat", "_found")
    )


def render_frontmatter(metadata: Column | str, body: Column | str) -> Column:
    """Sorted ``key: value`` header, blank line, body."""
    m = col(metadata)

    def line(e):
        v = F.coalesce(e["value"], F.lit("null"))
        s = F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0))
        word = s.rlike(r"^[\p{L}_/][^:#\n]*[^:#\s]$|^\p{L}$") & ~s.isin(*NULLS, *TRUE, *FALSE) & ~s.rlike(r"\p{Cntrl}")
        quoted = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))
        text = F.when(word, s).when(s.rlike(r"\p{Cntrl}"), v).otherwise(quoted)
        return F.concat(e["key"], F.lit(": "), F.when(v.startswith('"'), text).otherwise(v))

    lines = F.transform(F.array_sort(F.map_entries(m)), line)
    header = F.concat(F.lit("---\n"), F.array_join(F.concat(lines, F.array(F.lit("---"))), "\n"))
    return F.concat(header, F.lit("\n\n"), col(body))


def missing_fields(metadata: Column | str) -> Column:
    """Required fields that are absent or falsy by their type, sorted."""
    m = col(metadata)
    names = F.array(*[F.lit(f) for f in sorted(REQUIRED_FIELDS)])
    nothing = ("null", "false", "0", "-0", "0.0", "-0.0", '""', "[]", "{}")
    return F.filter(names, lambda f: F.coalesce(m[f], F.lit("null")).isin(*nothing))


def is_complete(metadata: Column | str) -> Column:
    return F.size(missing_fields(metadata)) == 0


@F.pandas_udf(T.StringType())
def json_ascii(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: json.dumps(json.loads(t), separators=(",", ":")), na_action="ignore"
    )


def metadata_json(metadata: Column | str, quirks: str = "fixed") -> Column:
    def pair(e):
        v = F.coalesce(e["value"], F.lit("null"))
        return F.concat(json_string(e["key"]), F.lit(":"), F.when(v.rlike(f"^{DATE}$"), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v))

    pairs = F.array_join(F.transform(F.map_entries(col(metadata)), pair), ",")
    js = F.concat(F.lit("{"), pairs, F.lit("}"))
    return json_ascii(js) if quirks == "reference" else js


def metadata_context(metadata: Column | str, quirks: str = "fixed") -> Column:
    """Sentence naming the document; empty when there is no metadata."""
    m = col(metadata)
    return F.when(
        F.coalesce(F.size(m), F.lit(0)) > 0,
        F.concat(F.lit(CONTEXT_HEAD), metadata_json(m, quirks), F.lit("\n\n")),
    ).otherwise(F.lit(""))


def explain_prompt(metadata: Column | str, first_chunk: Column | str, most: int = EXPLAIN_CHARS) -> Column:
    """Request for missing fields, with the first ``most`` characters of the first chunk."""
    c = col(first_chunk)
    shown = F.when(
        F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))
    ).otherwise(c)
    return F.concat(
        F.lit(EXPLAIN_TASK),
        F.coalesce(metadata_json(metadata), F.lit("{}")),
        F.lit(EXPLAIN_CHUNK), shown, F.lit(EXPLAIN_END),
    )


def parse_generated(response: Column | str) -> Column:
    """Generated metadata as a map; a response outside the schema gives an empty map."""
    r = F.from_json(col(response), METADATA_SCHEMA)
    whole = F.lit(True)
    for f in REQUIRED_FIELDS:
        whole = whole & r[f].isNotNull()
    pairs = [x for f in REQUIRED_FIELDS for x in (F.lit(f), json_string(r[f]))]
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(whole, F.create_map(*pairs)), empty)


def merge_metadata(existing: Column | str, generated: Column | str) -> Column:
    """Generated values win; existing keys keep their place."""
    a, b = col(existing), col(generated)
    kept = F.transform_values(
        a, lambda k, v: F.when(F.map_contains_key(b, k), b[k]).otherwise(v)
    )
    return F.map_concat(kept, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))
