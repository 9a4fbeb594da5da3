"""Greedy packing of an ordered array, one pass per row.

A document is one row, its lines one array column, so packing needs no shuffle:
a fold walks the array and appends to its result only when a chunk closes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import windows
from ..functions.tokens import let, max_chars, token_count

CUT = "struct<st:int,n:int,tk:int,solo:boolean>"
NO_CUTS = f"array<{CUT}>"
PIECE = "struct<text:string,token_count:int>"


def cut(st: Column, n: Column, tk: Column, solo: bool = False) -> Column:
    return F.array(
        F.struct(st.alias("st"), n.alias("n"), tk.alias("tk"), F.lit(solo).alias("solo"))
    )


def no_cuts() -> Column:
    return F.array().cast(NO_CUTS)


def span(items: Column, st: Column, n: Column) -> Column:
    """``n`` items from ``st`` on.

    ``slice`` copies the whole array on each call, which is quadratic when every
    chunk of a long document takes one; single elements are read in place.
    """
    return F.transform(F.sequence(st, st + n - F.lit(1)), lambda i: F.get(items, i))


def blocked_fold(items: Column, fields: dict[str, Column], kind: str, step) -> Column:
    """Fold an array into a small state plus a growing ``out`` array.

    ``aggregate`` copies its state after every element, so a fold that carries its
    result is quadratic on long documents.  Here an inner fold runs over a block of
    items and starts with an empty ``out``; the outer fold adds the block's part.
    With blocks of about the square root of the length, little is copied.

    ``fields`` names the other state fields and their start values.
    """

    def state(values, out):
        return F.struct(*[values(f).alias(f) for f in fields], out.alias("out"))

    def fold(bound):
        size = F.size(bound)
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(size)).cast("int"))
        last = F.floor((size - F.lit(1)) / width).cast("int")
        blocks = F.when(size > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def run_block(a, b):
            part = span(bound, b * width, F.least(width, size - b * width))
            inner = F.aggregate(part, state(lambda f: a[f], F.array().cast(kind)), step)
            return let(inner, lambda r: state(lambda f: r[f], F.concat(a["out"], r["out"])))

        return F.aggregate(blocks, state(lambda f: fields[f], F.array().cast(kind)), run_block)

    # Bound first: an expression would be evaluated again for each element read.
    return let(items, fold)


def greedy_cuts(sizes: Column, cap: int) -> Column:
    """Pack ``array<int>`` sizes into runs whose sum stays within ``cap``.

    An item larger than ``cap`` closes the open run and stands alone (``solo``).
    Returns ``array<struct<st,n,tk,solo>>`` with 0-based starts.
    """
    zero, one = F.lit(0), F.lit(1)

    def state(i, st, tk, out):
        return F.struct(i.alias("i"), st.alias("st"), tk.alias("tk"), out.alias("out"))

    def open_run(a):
        return F.when(a["i"] > a["st"], cut(a["st"], a["i"] - a["st"], a["tk"])).otherwise(no_cuts())

    def step(a, k):
        nxt = a["i"] + one
        return (
            F.when(
                k > F.lit(cap),
                state(nxt, nxt, zero, F.concat(a["out"], open_run(a), cut(a["i"], one, k, True))),
            )
            .when(
                (a["i"] > a["st"]) & (a["tk"] + k > F.lit(cap)),
                state(nxt, a["i"], k, F.concat(a["out"], open_run(a))),
            )
            .otherwise(state(nxt, a["st"], a["tk"] + k, a["out"]))
        )

    start = {"i": zero, "st": zero, "tk": zero}
    return let(blocked_fold(sizes, start, NO_CUTS, step), lambda a: F.concat(a["out"], open_run(a)))


def render(cuts: Column, items: Column, chunk_size: int, sized: Column | None = None) -> Column:
    """Turn cuts over an array of strings into ``array<struct<text,token_count>>``.

    Solo items are cut into windows of the widest text that fits the size, or into the pieces that a counter found
    (``sized``).
    """

    def piece(text, tk):
        return F.struct(text.alias("text"), tk.alias("token_count"))

    def expand(c):
        whole = F.array(piece(F.array_join(span(items, c["st"], c["n"]), ""), c["tk"]))
        parts = F.transform(
            windows(F.element_at(items, c["st"] + F.lit(1)), max_chars(chunk_size)),
            lambda s: piece(s, token_count(s)),
        )
        if sized is not None:
            parts = F.get(sized, c["st"])["parts"]
        return F.when(c["solo"], parts).otherwise(whole)

    return F.flatten(F.transform(cuts, expand))
