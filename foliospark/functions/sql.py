"""SQL names for the main expressions and lateral table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import LINE

# Plain SQL macros: the optimizer sees through them.
MACROS = {
    "token_count(s STRING)": ("INT", "CAST(length(s) DIV 4 + 1 AS INT)"),
    "norm_newlines(s STRING)": ("STRING", r"regexp_replace(s, '\\r\\n?', '\n')"),
    "tail_sample(s STRING, n INT)": ("STRING", "right(s, 4 * n)"),
    "completion_budget(tokens BIGINT, ratio INT)": (
        "INT",
        "CAST(least(40000, greatest(tokens * ratio DIV 100, (tokens * 450 + 99) DIV 100, 4096)) AS INT)",
    ),
}


_WINDOWS = "regexp_extract_all({}, concat('(?s).{{1,', CAST(4 * n - 1 AS STRING), '}}'), 0)"
_CUT = "array(named_struct('st', {}, 'n', {}, 'tk', {}, 'solo', {}))"
_NO_CUTS = "CAST(array() AS ARRAY<STRUCT<st: INT, n: INT, tk: INT, solo: BOOLEAN>>)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _state(i: str, st: str, tk: str, out: str) -> str:
    return f"named_struct('i', {i}, 'st', {st}, 'tk', {tk}, 'out', {out})"


def _open_run(a: str) -> str:
    return f"CASE WHEN {a}.i > {a}.st THEN {_CUT.format(f'{a}.st', f'{a}.i - {a}.st', f'{a}.tk', 'false')} ELSE {_NO_CUTS} END"


def _text_fold() -> str:
    """The pieces of a text ``t`` for the size ``n``: the fold of the ``text`` chunker, in blocks of about the square root of
    the number of lines, as :func:`foliospark.operators.pack.blocked_fold` does it."""
    alone = _state("a.i + 1", "a.i + 1", "0", f"concat(a.out, {_open_run('a')}, {_CUT.format('a.i', '1', 'k', 'true')})")
    closes = _state("a.i + 1", "a.i", "k", f"concat(a.out, {_open_run('a')})")
    joins = _state("a.i + 1", "a.st", "a.tk + k", "a.out")
    step = f"CASE WHEN k > n THEN {alone} WHEN a.i > a.st AND a.tk + k > n THEN {closes} ELSE {joins} END"
    width = "CAST(greatest(64, ceil(sqrt(size(ks)))) AS INT)"
    block = "transform(sequence(b * w, least((b + 1) * w, size(ks)) - 1), j -> get(ks, j))"
    inner = f"aggregate({block}, {_state('o.i', 'o.st', 'o.tk', _NO_CUTS)}, (a, k) -> {step})"
    outer = _let("r", inner, _state("r.i", "r.st", "r.tk", "concat(o.out, r.out)"))
    blocks = "CASE WHEN size(ks) > 0 THEN sequence(0, CAST((size(ks) - 1) DIV w AS INT)) ELSE CAST(array() AS ARRAY<INT>) END"
    folded = f"aggregate({blocks}, {_state('0', '0', '0', _NO_CUTS)}, (o, b) -> {outer}, z -> concat(z.out, {_open_run('z')}))"
    cuts = _let("ks", "transform(ls, s -> CAST(length(s) DIV 4 + 1 AS INT))", _let("w", width, folded))
    piece = "named_struct('chunk', {}, 'tokens', {})"
    parts = f"transform({_WINDOWS.format('get(ls, c.st)')}, s -> {piece.format('s', 'CAST(length(s) DIV 4 + 1 AS INT)')})"
    whole = f"array({piece.format("array_join(transform(sequence(c.st, c.st + c.n - 1), j -> get(ls, j)), '')", 'c.tk')})"
    pieces = f"flatten(transform({cuts}, c -> CASE WHEN c.solo THEN {parts} ELSE {whole} END))"
    lines = rf"regexp_extract_all(regexp_replace(t, r'\r\n?', '\n'), r'{LINE}', 0)"
    return _let("ls", lines, pieces)


#: ``LATERAL split_overlong(text, chunk_size)``: windows of the widest fitting text.
#: ``LATERAL chunk_text(text, chunk_size)``: the ``text`` chunker.
TABLES = {
    "chunk_text(t STRING, n INT)": (
        "chunk_index INT, chunk STRING, chunk_tokens INT",
        # No filter here: it would turn the lateral call into a join on the whole text.
        f"SELECT CAST(pos AS INT), col.chunk, col.tokens FROM posexplode({_text_fold()})",
    ),
    "split_overlong(t STRING, n INT)": (
        "piece_index INT, piece STRING, piece_tokens INT",
        "SELECT CAST(pos AS INT), col, CAST(length(col) DIV 4 + 1 AS INT)"
        f" FROM posexplode({_WINDOWS.format('t')})",
    ),
}


def register_functions(spark: SparkSession) -> None:
    for signature, (kind, body) in MACROS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({columns}) RETURN {body}")
