"""Text chunks of documents that are too large for one row: lines in, chunks out.

A document is a set of (key, line_no, line) rows.  Its lines are dealt out in blocks of ``block_lines``, so one document
is many tasks.  Greedy packing meets a block with some tokens in the open chunk; where the first cut falls depends on them,
and from there on everything is known.  So each block makes a small table, from the tokens carried in to those carried
out and the chunks closed; one pass over the tables of a document tells every block what is carried in; and the blocks
number their chunks.  No row or task ever holds more of a document than a block or a chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_newlines, split_lines, windows
from ..functions.tokens import max_chars, token_count

BLOCK_LINES = 4_096
BATCH_ROWS = 4_096


def document_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line) of documents that do fit in rows."""
    rows = docs.select(key, F.posexplode_outer(split_lines(norm_newlines("text"))).alias("line_no", "line"))
    return rows.filter("line IS NOT NULL").withColumn("line_no", F.col("line_no").cast("bigint"))


def block_table(sizes: np.ndarray, pieces: np.ndarray, cap: int) -> dict:
    """What a block does to any number of tokens carried in.

    ``sums``: running totals up to the first beyond ``cap``.  ``left``/``closed``: tokens carried out and chunks closed if
    a new chunk starts at that line.  ``total``: all tokens, for blocks that cut nowhere."""
    n, sums = len(sizes), np.cumsum(sizes)
    before = sums - sizes
    following = np.searchsorted(sums, before + cap, "right")  # the line that the chunk starting here can't take
    left, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if sizes[i] > cap:
            left[i], closed[i] = left[i + 1], closed[i + 1] + pieces[i]
        elif following[i] == n:
            left[i] = sums[-1] - before[i]
        else:
            left[i], closed[i] = left[following[i]], closed[following[i]] + 1
    most = min(n, int(np.searchsorted(sums, cap, "right")) + 1)
    return {"sums": sums[:most], "left": left[:most], "closed": closed[:most], "total": int(sums[-1])}


def carried(state: tuple[int, int], table: dict, cap: int) -> tuple[int, int]:
    """(tokens in the open chunk, chunks closed) after a block."""
    tokens, chunks = state
    if not tokens:
        return int(table["left"][0]), chunks + int(table["closed"][0])
    cut = bisect_right(table["sums"], cap - tokens)
    if cut == len(table["sums"]):
        return tokens + table["total"], chunks
    return int(table["left"][cut]), chunks + 1 + int(table["closed"][cut])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def chunk_lines(lines: DataFrame, chunk_size: int, key: str = "doc_id", block_lines: int = BLOCK_LINES) -> DataFrame:
    """(key, chunk_index, text, token_count): the chunks that ``chunk_text`` makes of the same lines."""
    wide = max_chars(chunk_size)
    size = token_count("line").cast("bigint")
    sized = lines.select(
        key, "line_no", "line", size.alias("size"), F.floor(F.col("line_no") / block_lines).alias("block"),
        F.when(size > chunk_size, F.ceil(F.length("line") / wide)).otherwise(1).cast("bigint").alias("pieces"),
    )
    name, kind = lines.select(key).limit(0).toArrow().schema.field(0).type, lines.schema[key].dataType.simpleString()
    numbers = pa.list_(pa.int64())
    table_schema = pa.schema([(key, name), ("block", pa.int64()), ("sums", numbers), ("left", numbers), ("closed", numbers), ("total", pa.int64())])
    entry_schema = pa.schema([(key, name), ("block", pa.int64()), ("tokens", pa.int64()), ("chunks", pa.int64())])
    place_schema = pa.schema([(key, name), ("line_no", pa.int64()), ("chunk", pa.int64())])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (doc, block), rows in groupby(_tuples(batches), itemgetter(0, 1)):
            sizes, pieces = np.array([r[3:] for r in rows], np.int64).T
            yield doc, block, *block_table(sizes, pieces, chunk_size).values()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, rows in groupby(_tuples(batches), itemgetter(0)):
            state = (0, 0)
            for _, block, *table in rows:
                yield doc, block, *state
                state = carried(state, dict(zip(("sums", "left", "closed", "total"), table)), chunk_size)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (doc, _), rows in groupby(_tuples(batches), itemgetter(0, 1)):
            tokens = None
            for _, _, line_no, n, pieces, carried_in, closed in rows:
                if tokens is None:
                    tokens, chunk = carried_in, closed
                if tokens and tokens + n > chunk_size:
                    tokens, chunk = 0, chunk + 1
                yield doc, line_no, chunk
                tokens, chunk = (0, chunk + pieces) if n > chunk_size else (tokens + n, chunk)

    narrow = sized.select(key, "block", "line_no", "size", "pieces")
    by_block = narrow.repartition(key, "block").sortWithinPartitions(key, "block", "line_no")
    found = by_block.mapInArrow(
        lambda b: _batches(tables(b), table_schema), f"{key} {kind}, block long, sums array<long>, left array<long>, closed array<long>, total long")
    start = found.repartition(key).sortWithinPartitions(key, "block").mapInArrow(
        lambda b: _batches(entries(b), entry_schema), f"{key} {kind}, block long, tokens long, chunks long")
    known = narrow.join(start, [key, "block"]).select(key, "block", "line_no", "size", "pieces", "tokens", "chunks")
    placed = known.repartition(key, "block").sortWithinPartitions(key, "block", "line_no").mapInArrow(
        lambda b: _batches(places(b), place_schema), f"{key} {kind}, line_no long, chunk long")
    rows = sized.join(placed, [key, "line_no"])
    # A long line is cut by size; the pieces are chunks of their own.
    parts = F.when(F.col("size") > chunk_size, windows("line", wide)).otherwise(F.array("line"))
    rows = rows.select(key, "line_no", "chunk", F.posexplode(parts).alias("piece", "s"))
    return (
        rows.groupBy(key, (F.col("chunk") + F.col("piece")).cast("int").alias("chunk_index"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "s"))).alias("lines"), F.sum(token_count("s")).cast("int").alias("token_count"))
        .select(key, "chunk_index", F.array_join(F.transform("lines", lambda x: x["s"]), "").alias("text"), "token_count")
    )
