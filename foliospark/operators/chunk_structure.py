"""Structure-aware chunkers for prose and Markdown.

A text is cut into small pieces, each followed by a break of known strength
(word < sentence < newline < blank line < block < heading).  Packing fills a chunk
up to the size, and on overflow cuts at the strongest, then latest, break in the
open run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, windows
from ..functions.tokens import CHARS_PER_TOKEN, TokenCounter, let, token_count
from .chunk_text import chunk_text, explode_pieces
from .pack import blocked_fold, span

WORD, SENTENCE, NEWLINE = 1, 2, 3
BLOCK, RULE, HEADING = 40, 41, 48
END = 99

LINE_RUN = r"[^\n]*\n+|[^\n]+"
SENTENCE_RUN = r"(?s).+?[.!?]+[\"')\]]*\s+|(?s).+"
WORD_RUN = r"\S+\s*|\s+"
FENCE_RUN = r"(?ms)^(?:```|~~~).*?^(?:```|~~~)[^\n]*\n*|[^\n]*\n+|[^\n]+"
HEADING_LINE = r"^#{1,6}(?:\s|$)"
RULE_LINE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\n*$"
FENCE_LINE = r"^(?:```|~~~)"
LIST_LINE = r"^\s*(?:[-*+]|\d+[.)])\s"
TABLE_LINE = r"^\s*\|"


def _piece(s: Column, lvl: Column) -> Column:
    return F.struct(s.alias("s"), lvl.cast("int").alias("lvl"))


def _rtrim_length(s: Column) -> Column:
    return F.length(F.rtrim(F.translate(s, "\n\t\r", "   ")))


def _parts(s: Column, lvl: Column, pattern: str, inner: int, finer) -> Column:
    """Cut one piece by a pattern; the last part keeps the break of the whole."""
    return let(
        F.regexp_extract_all(s, F.lit(pattern), F.lit(0)),
        lambda found: F.flatten(
            F.transform(
                found,
                lambda p, i: finer(
                    p, F.when(i == F.size(found) - F.lit(1), lvl).otherwise(F.lit(inner))
                ),
            )
        ),
    )


def _refine(s: Column, lvl: Column, cap: int) -> Column:
    """Only pieces that cannot fit a chunk are cut finer: sentence, word, character."""

    def chars(p, v):
        cut = let(
            windows(p, cap),
            lambda wins: F.transform(
                wins,
                lambda w, i: _piece(w, F.when(i == F.size(wins) - F.lit(1), v).otherwise(F.lit(0))),
            ),
        )
        return F.when(_rtrim_length(p) <= cap, F.array(_piece(p, v))).otherwise(cut)

    def words(p, v):
        return F.when(_rtrim_length(p) <= cap, F.array(_piece(p, v))).otherwise(
            _parts(p, v, WORD_RUN, WORD, chars)
        )

    def lines(p, v):
        return F.when(_rtrim_length(p) <= cap, F.array(_piece(p, v))).otherwise(
            _parts(p, v, SENTENCE_RUN, SENTENCE, words)
        )

    return F.when(_rtrim_length(s) <= cap, F.array(_piece(s, lvl))).otherwise(
        _parts(s, lvl, LINE_RUN, NEWLINE, lines)
    )


def prose_pieces(text: Column, cap: int) -> Column:
    """Lines, each followed by a break as strong as its run of newlines."""
    runs = F.regexp_extract_all(text, F.lit(LINE_RUN), F.lit(0))

    def one(s):
        newlines = F.length(s) - F.length(F.rtrim(s, F.lit("\n")))
        lvl = F.when(newlines == 0, F.lit(END)).otherwise(
            F.least(F.lit(NEWLINE - 1) + newlines, F.lit(BLOCK - 1))
        )
        return _refine(s, lvl, cap)

    return F.flatten(F.transform(runs, one))


def markdown_pieces(runs: Column, cap: int) -> Column:
    """Lines and whole fenced blocks; the break before a heading is the strongest."""
    size = F.size(runs)

    def one(s, i):
        nxt = F.get(runs, i + F.lit(1))
        marks = F.length(F.regexp_extract(nxt, r"^(#+)", 1))
        newlines = F.length(s) - F.length(F.rtrim(s, F.lit("\n")))
        lvl = (
            F.when(i == size - F.lit(1), F.lit(END))
            .when(nxt.rlike(HEADING_LINE), F.lit(HEADING) - marks)
            .when(nxt.rlike(RULE_LINE) | s.rlike(RULE_LINE), F.lit(RULE))
            .when(s.rlike(HEADING_LINE), F.lit(NEWLINE))
            .when((newlines > 1) | nxt.rlike(FENCE_LINE) | s.rlike(FENCE_LINE), F.lit(BLOCK))
            .when(nxt.rlike(LIST_LINE), F.lit(BLOCK - 1))
            .otherwise(F.lit(NEWLINE))
        )
        return _refine(s, lvl, cap)

    return F.flatten(F.transform(runs, one))


def level_cuts(sizes: Column, cap: int) -> Column:
    """Fill chunks to ``cap`` characters, cutting at the strongest break.

    ``sizes`` is array<struct<lvl,ln,fit>>: break after the piece, its length, and
    its length without trailing space.  The result is array<struct<st,n>>.
    """
    zero, one, room = F.lit(0), F.lit(1), F.lit(cap)
    kind = "array<struct<st:int,n:int>>"

    def state(i, st, ln, out):
        return F.struct(i.alias("i"), st.alias("st"), ln.alias("ln"), out.alias("out"))

    def cut(st, n):
        return F.array(F.struct(st.alias("st"), n.alias("n")))

    def best_break(st, i):
        """1-based offset of the cut in the open run."""
        ranked = F.transform(
            span(sizes, st, i - st),
            lambda p, q: F.struct(p["lvl"].alias("lvl"), (q + one).alias("q")),
        )
        return F.array_max(ranked)["q"]

    def length_of(st, n):
        return F.aggregate(span(sizes, st, n), zero, lambda t, p: t + p["ln"])

    def step(a, x):
        def full(b):
            return (b["st"] < b["i"]) & (b["ln"] + x["fit"] > room)

        def shrink(b, _):
            def close(n):
                return state(
                    b["i"], b["st"] + n, b["ln"] - length_of(b["st"], n),
                    F.concat(b["out"], cut(b["st"], n)),
                )

            return F.when(full(b), let(best_break(b["st"], b["i"]), close)).otherwise(b)

        def grow(b):
            return state(b["i"] + one, b["st"], b["ln"] + x["ln"], b["out"])

        # At most one cut per piece of the open run.
        shrunk = F.aggregate(F.sequence(a["st"], a["i"]), a, shrink)
        return F.when(full(a), let(shrunk, grow)).otherwise(grow(a))

    start = {"i": zero, "st": zero, "ln": zero}
    return let(
        blocked_fold(sizes, start, kind, step),
        lambda a: F.concat(
            a["out"],
            F.when(a["i"] > a["st"], cut(a["st"], a["i"] - a["st"])).otherwise(F.array().cast(kind)),
        ),
    )


def _pack(df: DataFrame, cap: int) -> DataFrame:
    texts = F.transform(
        F.col("cuts"),
        lambda c: strip(
            F.array_join(
                F.transform(
                    F.sequence(c["st"], c["st"] + c["n"] - F.lit(1)), lambda i: F.get("items", i)["s"]
                ),
                "",
            )
        ),
    )
    sizes = F.transform(
        "items",
        lambda p: F.struct(
            p["lvl"].alias("lvl"), F.length(p["s"]).alias("ln"), _rtrim_length(p["s"]).alias("fit")
        ),
    )
    df = (
        df.withColumn("sizes", sizes)
        .withColumn("cuts", level_cuts(F.col("sizes"), cap))
        .withColumn("texts", texts)
        .drop("sizes")
    )
    pieces = F.transform(
        F.filter("texts", lambda s: s != F.lit("")),
        lambda s: F.struct(s.alias("text"), token_count(s).alias("token_count")),
    )
    return explode_pieces(df.withColumn("pieces", pieces).drop("items", "cuts", "texts"))


def chunk_semantic(docs: DataFrame, chunk_size: int, splitter: str = "structure", counter: TokenCounter | None = None) -> DataFrame:
    if splitter == "lines":
        return chunk_text(docs, chunk_size, counter)
    cap = CHARS_PER_TOKEN * chunk_size
    return _pack(docs.withColumn("items", prose_pieces(F.col("text"), cap)).drop("text"), cap)


def chunk_markdown(docs: DataFrame, chunk_size: int, splitter: str = "structure", counter: TokenCounter | None = None) -> DataFrame:
    if splitter == "lines":
        return chunk_text(docs, chunk_size, counter)
    cap = CHARS_PER_TOKEN * chunk_size
    runs = docs.withColumn("runs", F.regexp_extract_all("text", F.lit(FENCE_RUN), F.lit(0))).drop("text")
    return _pack(runs.withColumn("items", markdown_pieces(F.col("runs"), cap)).drop("runs"), cap)


def _line_rows(text: Column | str) -> Column:
    """array<struct<line_no,kind,heading_level,title,token_count>> of a text's lines."""
    from ..functions.text import split_lines

    def one(s, i):
        kind = (
            F.when(s.rlike(FENCE_LINE), F.lit("fence"))
            .when(is_blank(s), F.lit("blank"))
            .when(s.rlike(HEADING_LINE), F.lit("heading"))
            .when(s.rlike(RULE_LINE), F.lit("rule"))
            .when(s.rlike(LIST_LINE), F.lit("list"))
            .when(s.rlike(TABLE_LINE), F.lit("table"))
            .otherwise(F.lit("text"))
        )
        heading = F.regexp_extract(s, r"^(#{1,6})(?:\s|$)", 1)
        return F.struct(
            i.alias("line_no"),
            kind.alias("kind"),
            F.length(heading).alias("heading_level"),
            F.when(F.length(heading) > 0, strip(F.regexp_replace(s, r"^#+", ""))).alias("title"),
            token_count(s).alias("token_count"),
        )

    return F.transform(split_lines(text), one)


def markdown_lines(docs: DataFrame) -> DataFrame:
    """One narrow row per line with its kind and fence state."""
    rows = docs.withColumn("rows", _line_rows("text")).drop("text")
    keep = [c for c in rows.columns if c != "rows"]
    return (
        rows.select(*keep, F.explode_outer("rows").alias("r"))
        .filter(F.col("r").isNotNull())
        .select(*keep, "r.*")
    )


def markdown_sections(docs: DataFrame) -> DataFrame:
    """Sections between headings; headings inside a fence do not count.

    Lines before the first heading are section 0, without level and title.  A fold in the row of a document, which keeps
    the open section and whether a fence is open: nothing is shuffled or sorted."""
    kind = "array<struct<section_id:int,heading_level:int,title:string,n_lines:bigint,n_tokens:bigint>>"
    zero, one = F.lit(0), F.lit(1).cast("bigint")
    fields = {
        "fenced": F.lit(False), "section_id": zero, "heading_level": zero, "title": F.lit(""),
        "n_lines": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint"),
    }
    names = list(fields)[1:]

    def closed(a):
        section = F.array(F.struct(*(a[n].alias(n) for n in names)))
        return F.when(a["n_lines"] > 0, F.concat(a["out"], section)).otherwise(a["out"])

    def step(a, x):
        fenced = a["fenced"] != (x["kind"] == "fence")
        starts = (x["kind"] == "heading") & ~fenced
        size = x["token_count"].cast("bigint")
        opened = (a["section_id"] + 1, x["heading_level"], F.coalesce(x["title"], F.lit("")), one, size)
        grown = (a["section_id"], a["heading_level"], a["title"], a["n_lines"] + one, a["n_tokens"] + size)

        def state(values, out):
            return F.struct(fenced.alias("fenced"), *(v.alias(n) for n, v in zip(names, values)), out.alias("out"))

        return F.when(starts, state(opened, closed(a))).otherwise(state(grown, a["out"]))

    rows = docs.withColumn("rows", _line_rows("text")).drop("text")
    keep = [c for c in rows.columns if c != "rows"]
    sections = let(blocked_fold(F.col("rows"), fields, kind, step), closed)
    return rows.select(*keep, F.explode_outer(sections).alias("s")).filter(F.col("s").isNotNull()).select(*keep, "s.*")
