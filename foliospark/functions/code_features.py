"""Per-line code features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip
from .tokens import col, let

# What a line that opens a block starts with.
FUNCTION_STARTS = ("def ", "function ", "func ", "fn ", "public ", "private ", "protected ", "static ")
TYPE_STARTS = ("class ", "struct ", "interface ", "enum ")
IMPORT_STARTS = ("import ", "include ", "require ", "using ")
MODULE_STARTS = ("namespace ", "module ", "package ")
COMMENT_STARTS = ("/**", "*/", "###", "///")
INDENTED_STARTS = ("def ", "class ", "function ", "public ", "private ")


ESCAPED_QUOTE = r"""\\["']"""
CLOSED_STRING = r""""[^"]*"|'[^']*'"""
OPEN_STRING = r"""(?s)["'].*$"""


def _starts(line: Column, starts) -> Column:
    """Prefix tests stay byte comparisons; a regex alternation is far slower per line."""
    found = line.startswith(starts[0])
    for s in starts[1:]:
        found = found | line.startswith(s)
    return found


def is_boundary(line: Column | str) -> Column:
    """The line starts a definition, import, comment rule, or is blank."""
    s = col(line)
    named = FUNCTION_STARTS + TYPE_STARTS + IMPORT_STARTS + MODULE_STARTS + COMMENT_STARTS
    return _starts(s, named) | (s.startswith("from ") & (F.locate(" import", s, 6) > 0)) | is_blank(s)


def is_keyword_start(line: Column | str) -> Column:
    return let(strip(col(line)), lambda s: _starts(s, INDENTED_STARTS))


def _without_closed_strings(line: Column) -> Column:
    quoted = line.contains('"') | line.contains("'")
    cleaned = F.regexp_replace(F.regexp_replace(line, ESCAPED_QUOTE, "E"), CLOSED_STRING, "S")
    return F.when(quoted, cleaned).otherwise(line)


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def line_features(line: Column | str) -> Column:
    """struct<boundary, keyword, brace, paren, open_string> of one line."""
    s = col(line)

    def count(rest):
        open_string = rest.contains('"') | rest.contains("'")
        bare = F.when(open_string, F.regexp_replace(rest, OPEN_STRING, "")).otherwise(rest)
        return let(
            bare,
            lambda b: F.struct(
                (_count(b, "{") - _count(b, "}")).cast("int").alias("brace"),
                (_count(b, "(") - _count(b, ")")).cast("int").alias("paren"),
                open_string.alias("open_string"),
            ),
        )

    def collect(c):
        return F.struct(
            is_boundary(s).alias("boundary"),
            is_keyword_start(s).alias("keyword"),
            c["brace"].alias("brace"),
            c["paren"].alias("paren"),
            c["open_string"].alias("open_string"),
        )

    return let(let(_without_closed_strings(s), count), collect)
