"""UDFs for the parts of XML handling that need a scanner or a real parser.

Texts can be long and Arrow batches hold thousands of them, so the UDFs take rows as Spark pickles them, a hundred at a time.
"""

from __future__ import annotations

import re
from xml.parsers import expat

from pyspark.sql import functions as F
from pyspark.sql import types as T

# One markup token or one run of text.  An unclosed "<" runs to the end.
TOKEN = re.compile(
    r"<!-->|<!--->|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?>|<\?.*?\?>|<[^>]*>|[^<]+|<.*", re.DOTALL
)
# Characters escaped in wrapped text.
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def _opaque(tok: str) -> bool:
    """Closed comment, CDATA section or processing instruction."""
    return (
        (tok.startswith("<!--") and tok.endswith("-->"))
        or (tok.startswith("<![CDATA[") and tok.endswith("]]>"))
        or (tok.startswith("<?") and tok.endswith("?>"))
    )


def _move(tok: str) -> int:
    return -1 if tok.startswith("</") else 0 if tok.endswith("/>") else 1


def well_formed(text: str) -> bool:
    parser = expat.ParserCreate()
    try:
        parser.Parse(text.encode("utf-8"), True)
        return True
    except (expat.ExpatError, UnicodeEncodeError):
        return False


def normalize(text: str) -> str:
    """Wrap root-level text in ``<p>``; add an ``<x>`` root where still needed."""
    if well_formed(text):
        return text
    out, depth = [], 0
    for m in TOKEN.finditer(text):
        tok = m.group()
        is_markup = tok[0] == "<" and tok[-1] == ">"
        if not is_markup:
            if depth:
                out.append(tok)
            else:
                out.append(f"<p>{tok.translate(ESCAPES) if tok.strip() else tok}</p>")
            continue
        out.append(tok)
        if not _opaque(tok):
            depth = max(0, depth + _move(tok))
    joined = "".join(out)
    return joined if well_formed(joined) else f"<x>{joined}</x>"


def spans(text: str) -> list[tuple[int, int]]:
    """Top-level elements and text runs; comments, CDATA and PIs are skipped."""
    found, depth, start = [], 0, None
    for m in TOKEN.finditer(text):
        tok = m.group()
        if tok[0] != "<":
            if depth == 0:
                found.append(m.span())
            continue
        if tok[-1] != ">":
            break
        if _opaque(tok):
            continue
        step = _move(tok)
        if step > 0 and depth == 0:
            start = m.start()
        if step == 0 and depth == 0:
            found.append(m.span())
        depth += step
        if step < 0 and depth == 0 and start is not None:
            found.append((start, m.end()))
            start = None
    return found


@F.udf(T.StringType(), useArrow=False)
def xml_normalize(text):
    return None if text is None else normalize(text)


@F.udf(SPANS, useArrow=False)
def xml_spans(text):
    return None if text is None else spans(text)


PARTS = T.StructType([T.StructField("norm", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType()))])


@F.udf(PARTS, useArrow=False)
def xml_parts(text, chunk_size):
    """The normalised text and, where it is longer than a chunk, its top-level elements: one pass to Python for both."""
    if text is None:
        return None, None
    norm = normalize(text)
    return norm, None if len(norm) // 4 + 1 <= chunk_size else [norm[a:b] for a, b in spans(norm)]


@F.udf(T.StringType(), useArrow=False)
def xml_wrap(text):
    return text if text is None or well_formed(text) else f"<x>{text}</x>"


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def xml_children(text):
    """Direct children of the root element, as written."""
    if text is None:
        return None
    marks = [m for m in TOKEN.finditer(text) if m.group()[0] == "<" and not _opaque(m.group())]
    opening = next((m for m in marks if not m.group().startswith(("<!", "</"))), None)
    closing = marks[-1] if marks else None
    if opening is None or closing.start() <= opening.start() or _move(opening.group()) == 0:
        return []
    inner = text[opening.end() : closing.start()]
    return [inner[a:b] for a, b in spans(inner)]
