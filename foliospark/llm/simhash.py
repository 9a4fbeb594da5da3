"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's 3-word shingles.  Fingerprints that
differ in at most ``MAX_BITS`` bits are linked; linked documents form components.

Distinct fingerprints are routed by pigeonhole: of four equal parts of the bits, linked fingerprints share at least one,
so four buckets per fingerprint bring all links together.  A bucket beyond ``BUCKET_ROWS`` is divided by the same rule
on its remaining bits, twice at most, so no link is lost; fingerprints that agree in 37 bits may meet in one task.  Inside a bucket, fingerprints are sorted by
their rank in the Gray code.  Neighbours are then alike, and every eight of them form a node that holds the bits they
all share, as a value and a mask; eight nodes form an upper node, up to a root.  Two nodes are compared by the
differences of the bits both share, which only grow on the way down: a pair of groups is dropped whole as soon as these
exceed ``MAX_BITS``, or once all its members are known to be in one component.

A bucket returns one edge per member to its local component, never all pairs, and ``graph.components`` joins them.

Null and empty texts have the fingerprint zero and are linked like any other.  A null id takes part; a component of
null ids only has a null id.  Repeated rows share a component.  A text's words are held by one task, so a very long one costs some times
its length.  Columns besides id and text are not read by ``near_groups`` and kept as they are by ``drop_near_copies``.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import durable
from .common import text_or_empty
from .graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BUCKET_ROWS = 20_000
FANOUT = 8
PAIRS_AT_ONCE = 40_000
FLUSH_ROWS = 150_000
HASHES_AT_ONCE = 1 << 16


def fingerprint(data: bytes) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[: -SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
    joined = b" ".join(words)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        h = np.array(
            [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE])],
            "<u8",
        )
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = (2 * set_bits > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _signed([fingerprint(x.as_py()) for x in batch.column("data")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# --- the index of one set of buckets ---


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the sequence of Gray codes."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class _Forest:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return changed
            changed = True
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class GrayIndex:
    """Nodes over fingerprints sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        self.fp, self.forest = fp, _Forest(len(fp))
        self.levels = []  # from the leaves: children [start, stop) one level below, bits all members have, bits any has
        ones, any_bit, owner = fp, fp, bucket
        while True:
            edge = np.r_[True, owner[1:] != owner[:-1]]
            first = np.maximum.accumulate(np.where(edge, np.arange(len(owner)), 0))
            start = np.flatnonzero((np.arange(len(owner)) - first) % FANOUT == 0)
            ones, any_bit, owner = np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(any_bit, start), owner[start]
            self.levels.append((start, np.r_[start[1:], self._size()], ones, any_bit))
            if len(owner) == 1 or (owner[1:] != owner[:-1]).all():
                break
        self.bucket = bucket
        self._uniform()

    def _size(self) -> int:
        return len(self.levels[-1][0]) if self.levels else len(self.fp)

    def _uniform(self) -> None:
        """Per level, the component of each node's members, or -1 if they have several."""
        low = high = self.forest.root
        self.component = [low]
        for start, *_ in self.levels:
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            self.component.append(np.where(low == high, low, -1))

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= MAX_BITS
        if near.any() and self.forest.join(i[near], j[near]):
            self._uniform()

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a child of a[k] and a child of b[k], each unordered pair once."""
        start, stop = self.levels[level][:2]
        na, nb = stop[a] - start[a], stop[b] - start[b]
        each = na * nb
        k = np.repeat(np.arange(len(a)), each)
        at = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
        i, j = start[a][k] + at // nb[k], start[b][k] + at % nb[k]
        keep = (a[k] != b[k]) | (i <= j)
        return i[keep], j[keep]

    def _open(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes (level 0: members) that may hold a link between two components."""
        ca, cb = self.component[level][a], self.component[level][b]
        may = (ca != cb) | (ca < 0)
        if level:
            _, _, ones, any_bit = self.levels[level - 1]
            shared = ~((ones[a] ^ any_bit[a]) | (ones[b] ^ any_bit[b]))
            may &= np.bitwise_count((ones[a] ^ ones[b]) & shared) <= MAX_BITS
        return may

    def link_all(self) -> np.ndarray:
        """Root of each member after all links within buckets are made."""
        for step in range(1, FANOUT + 1):  # neighbours first: it makes most groups uniform
            i = np.flatnonzero(self.bucket[step:] == self.bucket[:-step])
            self._link(i, i + step)
        top = len(self.levels)
        roots = np.arange(len(self.levels[-1][0]))
        work = [(top, roots, roots)]
        while work:
            level, a, b = work.pop()
            keep = self._open(level, a, b)
            a, b = a[keep], b[keep]
            if len(a) > PAIRS_AT_ONCE:
                work += [(level, a[s : s + PAIRS_AT_ONCE], b[s : s + PAIRS_AT_ONCE]) for s in range(0, len(a), PAIRS_AT_ONCE)]
            elif len(a) and level:
                work.append((level - 1, *self._children(level - 1, a, b)))
            elif len(a):
                self._link(a, b)
        return self.forest.root


def bucket_links(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, its local root) that connect what is linked within buckets."""
    order = np.lexsort((gray_rank(fp), bucket))
    fp = fp[order]
    root = GrayIndex(bucket[order], fp).link_all()
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


# --- over the whole table ---


def _parts(width: int) -> list:
    """Four (bucket, rest) choices: one quarter of the ``width`` bits of ``rest`` goes into the bucket."""
    s = width // 4
    out = []
    for p in range(4):
        value = F.shiftrightunsigned("rest", p * s).bitwiseAND(F.lit((1 << s) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << (p * s)) - 1))
        rest = low if p == 3 else F.shiftleft(F.shiftrightunsigned("rest", (p + 1) * s), p * s).bitwiseOR(low)
        out.append(F.struct(F.xxhash64(F.col("bucket"), F.lit(width + p), value).alias("bucket"), rest.alias("rest")))
    return out


def _buckets(nodes: DataFrame, most: int) -> DataFrame:
    """(bucket, fp) so that linked fingerprints share a bucket; buckets over ``most`` rows are divided, twice at
    most.  A bucket of the last round has 37 bits fixed; what agrees in all of these meets in one task, whatever its number."""
    pending, ready = nodes.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("bucket")), None
    for width in (64, 48, 36):
        split = pending.select("fp", F.explode(F.array(*_parts(width))).alias("x")).select("fp", "x.bucket", "x.rest")
        split = durable(split, "simhash-buckets")
        large = durable(split.groupBy("bucket").count().filter(F.col("count") > most).select("bucket"), "simhash-large")
        done = width == 36 or large.isEmpty()
        part = (split if done else split.join(large, "bucket", "left_anti")).select("bucket", "fp")
        ready = part if ready is None else ready.unionByName(part)
        if done:
            return ready
        pending = split.join(large, "bucket")


def fingerprint_edges(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints within MAX_BITS of each other, by way of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(parts):
            b, f = (np.concatenate(x) for x in zip(*parts))
            u, v = bucket_links(b, f.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

        for batch in batches:
            b, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
            if not len(b):
                continue
            held.append((b, f))
            if sum(len(x) for x, _ in held) >= FLUSH_ROWS:  # the last bucket may go on
                cut = int(np.searchsorted(b, b[-1]))
                if cut:
                    yield flush([*held[:-1], (b[:cut], f[:cut])])
                    held = [(b[cut:], f[cut:])]
        if held:
            yield flush(held)

    rows = _buckets(nodes, bucket_rows)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def fingerprint_components(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component_id) for (doc_id, fp) rows: the smallest doc_id of the component."""
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = durable(components(fingerprint_edges(nodes, bucket_rows)), "simhash-roots")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return durable(placed.join(ids, "root").select("fp", "component_id"), "simhash-components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = durable(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    placed = rows.join(fingerprint_components(rows), "fp")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; all its columns."""
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _signed([fingerprint((x.as_py() or "").encode()) for x in batch.column("row").field(text_col)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), fp], ["row", "fp"])

    marked = rows.mapInArrow(run, StructType([*rows.schema, StructField("fp", LongType())]))
    marked = durable(marked.withColumn("seat", F.monotonically_increasing_id()), "simhash-rows")  # seats are fixed once written
    small = marked.select(F.col(f"row.`{id_col}`").alias("doc_id"), "fp", "seat")
    # A component's first row: by id, nulls last, then by seat.  The largest key of a component may be on many rows, but
    # each fingerprint brings one row only.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "seat")
    best = durable(small.groupBy("fp").agg(F.min(key).alias("best")), "simhash-best")
    roots = components(fingerprint_edges(best.select("fp")))
    placed = best.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.seat").alias("seat"))
    return marked.join(kept, "seat", "left_semi").select("row.*")
