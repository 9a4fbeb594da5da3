"""Code chunker: prefer cuts at definitions outside open brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code_features import line_features
from ..functions.text import norm_newlines, split_lines
from ..functions.tokens import TokenCounter, exact, let, token_count
from .chunk_text import explode_pieces
from .pack import NO_CUTS, blocked_fold, cut, no_cuts, render, span

# A forced cut looks back over this many lines, from this length on.
LOOK_BACK = 20
LOOK_BACK_FROM = 10


def code_lines(lines: Column, sized: Column | None = None) -> Column:
    """array<struct<i,k,b,w,brace,paren,quote>> of a line array; ``sized`` holds a counter's sizes."""

    def one(s, i):
        return let(
            line_features(s),
            lambda f: F.struct(
                i.alias("i"),
                (token_count(s) if sized is None else F.get(sized, i)["k"]).alias("k"),
                f["boundary"].alias("b"),
                f["keyword"].alias("w"),
                f["brace"].alias("brace"),
                f["paren"].alias("paren"),
                f["open_string"].alias("quote"),
            ),
        )

    return F.transform(lines, one)


def code_cuts(feats: Column, chunk_size: int, keep_stale: bool) -> Column:
    """Cuts over the feature array in one pass.

    State: open run ``st``/``n``/``tk``, clamped bracket depths, closed cuts.
    ``keep_stale`` keeps the token tally after an overlong line that found no
    open run, which makes the next chunk close early.
    """
    zero, one, cap = F.lit(0), F.lit(1), F.lit(chunk_size)

    def state(st, n, tk, brace, paren, out):
        return F.struct(
            st.alias("st"), n.alias("n"), tk.alias("tk"),
            brace.alias("brace"), paren.alias("paren"), out.alias("out"),
        )

    def tokens(st, n):
        return F.aggregate(span(feats, st, n), zero, lambda t, x: t + x["k"])

    def look_back(a):
        first = F.greatest(zero, a["n"] - F.lit(LOOK_BACK)) + one
        marks = F.filter(
            F.sequence(first, a["n"] - one),
            lambda j: F.element_at(feats, a["st"] + j + one)["b"],
        )
        return F.when(a["n"] > LOOK_BACK_FROM, F.array_max(marks))

    def step(a, x):
        brace = F.greatest(zero, a["brace"] + x["brace"])
        paren = F.greatest(zero, a["paren"] + x["paren"])
        good = (
            (brace == 0) & (paren == 0) & ~x["quote"] & (x["b"] | ((x["i"] > 0) & x["w"]))
        )

        def close(j):
            before = F.concat(a["out"], cut(a["st"], a["n"], a["tk"]))
            split = F.concat(a["out"], cut(a["st"], j, tokens(a["st"], j)))
            kept = a["n"] - j + one
            return F.when(
                good | j.isNull(), state(x["i"], one, x["k"], brace, paren, before)
            ).otherwise(state(a["st"] + j, kept, tokens(a["st"] + j, kept), brace, paren, split))

        grown = (
            F.when(
                (a["n"] > 0) & (a["tk"] + x["k"] > cap),
                let(F.when(~good, look_back(a)), close),
            )
            .otherwise(state(a["st"], a["n"] + one, a["tk"] + x["k"], brace, paren, a["out"]))
        )

        def cut_overlong(p):
            alone = cut(x["i"], one, x["k"], True)
            nxt = x["i"] + one
            stale = p["tk"] if keep_stale else zero
            return (
                F.when(x["k"] <= cap, p)
                .when(
                    p["n"] > 1,
                    state(
                        nxt, zero, zero, brace, paren,
                        F.concat(p["out"], cut(p["st"], p["n"] - one, p["tk"] - x["k"]), alone),
                    ),
                )
                .otherwise(state(nxt, zero, stale, brace, paren, F.concat(p["out"], alone)))
            )

        return let(grown, cut_overlong)

    start = dict.fromkeys(("st", "n", "tk", "brace", "paren"), zero)
    return let(
        blocked_fold(feats, start, NO_CUTS, step),
        lambda a: F.concat(
            a["out"], F.when(a["n"] > 0, cut(a["st"], a["n"], a["tk"])).otherwise(no_cuts())
        ),
    )


def chunk_code(docs: DataFrame, chunk_size: int, quirks: str = "fixed", counter: TokenCounter | None = None) -> DataFrame:
    df, sized = docs.withColumn("lines", split_lines(norm_newlines("text"))), None
    if exact(counter):
        df, sized = df.withColumn("sized", counter.sized("lines", chunk_size)), F.col("sized")
    df = (
        df.withColumn("feats", code_lines(F.col("lines"), sized))
        .withColumn("cuts", code_cuts(F.col("feats"), chunk_size, quirks == "reference"))
        .withColumn("pieces", render(F.col("cuts"), F.col("lines"), chunk_size, sized))
    )
    return explode_pieces(df.drop("lines", "sized", "feats", "cuts", "text"))


def code_line_table(docs: DataFrame) -> DataFrame:
    """One narrow row per code line: number, tokens and features, no text."""
    feats = docs.withColumn(
        "feats", code_lines(split_lines(norm_newlines("text")))
    ).drop("text")
    keep = [c for c in feats.columns if c != "feats"]
    rows = feats.select(*keep, F.explode_outer("feats").alias("f")).filter(F.col("f").isNotNull())
    return rows.select(
        *keep,
        F.col("f.i").alias("line_no"),
        F.col("f.k").alias("token_count"),
        F.col("f.b").alias("is_boundary"),
        F.col("f.w").alias("is_keyword"),
        F.col("f.brace").alias("brace_delta"),
        F.col("f.paren").alias("paren_delta"),
        F.col("f.quote").alias("open_string"),
    )


def code_depth(docs: DataFrame) -> DataFrame:
    """Nesting depth after each line, never below zero: line_no, brace_depth, paren_depth beside the other columns.

    A fold in the row of a document, so nothing is shuffled or sorted."""
    zero = F.lit(0)
    kind = "array<struct<line_no:int,brace_depth:int,paren_depth:int>>"

    def step(a, x):
        def grown(depth):
            line = F.struct(x["i"].alias("line_no"), depth["brace"].alias("brace_depth"), depth["paren"].alias("paren_depth"))
            return F.struct(depth["brace"].alias("brace"), depth["paren"].alias("paren"), F.concat(a["out"], F.array(line)).alias("out"))

        depth = F.struct(*(F.greatest(zero, a[n] + x[n]).alias(n) for n in ("brace", "paren")))
        return let(depth, grown)

    feats = docs.withColumn("feats", code_lines(split_lines(norm_newlines("text")))).drop("text")
    keep = [c for c in feats.columns if c != "feats"]
    depths = blocked_fold(F.col("feats"), {"brace": zero, "paren": zero}, kind, step)["out"]
    rows = feats.select(*keep, F.explode_outer(depths).alias("d")).filter(F.col("d").isNotNull())
    return rows.select(*keep, "d.*")
