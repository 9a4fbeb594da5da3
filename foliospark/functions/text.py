"""Text primitives as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import col, let

# The characters that end a text line.
LINE_ENDS = r"\n\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}"
LINE = rf"[^{LINE_ENDS}]*[{LINE_ENDS}]|[^{LINE_ENDS}]+"
# Fixed value: the white space that Python's str.strip removes.
SPACES = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CLASS = f"[{SPACES}]"
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_RARE_ENDS = [chr(n) for n in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)]
_MARK = chr(0xFFFF)


def norm_newlines(text: Column | str) -> Column:
    """CRLF and CR become LF; rows without CR skip the regex."""
    t = col(text)
    return F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)


def split_lines(text: Column | str) -> Column:
    """Lines with their terminators; the empty string has no lines.

    Text that ends its lines with LF only (nearly all of it) is cut by a literal
    split after marking each LF; only rows holding a rarer terminator, or the
    marker itself, pay for the regex.
    """

    def cut(t):
        rare = t.contains(_MARK)
        for ch in _RARE_ENDS:
            rare = rare | t.contains(ch)
        plain = F.array_remove(
            F.split(F.replace(t, F.lit("\n"), F.lit("\n" + _MARK)), _MARK, -1), ""
        )
        return F.when(rare, F.regexp_extract_all(t, F.lit(LINE), F.lit(0))).otherwise(plain)

    return let(col(text), cut)


def is_blank(text: Column | str) -> Column:
    return strip(text) == F.lit("")


def strip(text: Column | str) -> Column:
    return F.trim(col(text), F.lit(SPACE_CHARS))


def windows(text: Column | str, width: int) -> Column:
    """Cut a text into consecutive windows of ``width`` characters.

    A regex does it in one pass, where a substring per window rescans the text.
    Very wide windows over characters outside the basic plane would make the regex
    recurse deeply, so those texts take the substrings.
    """
    t = col(text)
    one_pass = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    if width <= 1000:
        return one_pass
    last = F.floor((F.length(t) - F.lit(1)) / F.lit(width)).cast("int")
    by_position = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), last)),
        lambda i: F.substring(t, i * F.lit(width) + F.lit(1), F.lit(width)),
    )
    return F.when(t.rlike(r"[\x{10000}-\x{10ffff}]"), by_position).otherwise(one_pass)


def preview(text: Column | str, lines: int = 5, chars: int = 200) -> Column:
    """First lines of a chunk, cut to ``chars`` characters plus an ellipsis."""
    head = F.array_join(F.slice(F.split(col(text), "\n", -1), 1, lines), "\n")
    return F.when(F.length(head) > chars, F.concat(F.substring(head, 1, chars), F.lit("..."))).otherwise(head)
