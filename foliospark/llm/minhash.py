"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, confirmed on full sets.

A document's set holds the hashes of its distinct 4-word shingles.  Documents with equal sets are one node.  One pass over
a set takes its least hash in each of ``BINS`` ranges; an empty bin borrows from the non-empty bin that comes first in a
random order of its own, so that two sets agree in any bin with the probability of their similarity.  ``ROWS`` bins make a
band, and nodes that agree in a band share a bucket: two sets at the threshold of 0.8 miss all 64 buckets with probability
8e-6, while sets at 0.5 share one bucket in 256.

A bucket proposes a star, from its least node to every other, never all pairs.  Proposals are confirmed by the
intersection of the full sets.  A star may miss a link between two of its points.  The nodes of buckets that are not yet
of one component therefore go on, in exact buckets: one for each shingle in the rarest fifth of their sets.  These
propose stars from nodes outside their largest component, 64 times as many each round and never one twice, until each
bucket is of one component.  Pairs are not proposed where it is certain that they share too little: by the rarer shingles
that only one of them has, or by what each shares with the main node of the bucket.  No bucket is capped or left undecided.

Documents without words have an empty set and are linked with nothing.  A null text is empty.  A null id takes part; the
component of null ids only has a null id.  Repeated rows share a node.  Texts are read in pieces, so a very long one costs
some bytes a word.  Input columns other than id and text are not read.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import text_or_empty
from .graph import components

SHINGLE = 4
THRESHOLD = 80  # per cent
ROWS, BANDS = 8, 64
BINS = ROWS * BANDS
MORE_CENTRES = 64
PIECE_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Multipliers of the words of a shingle and of the rows of a band; any odd numbers do.
_WORD_FACTORS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_ROW_FACTORS = _mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
#: For every bin a random order of all bins: the smaller the number, the earlier it lends.
_LENDERS = (_mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(BINS, BINS)


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end between words."""
    at = 0
    while at < len(data):
        stop = at + PIECE_BYTES
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield data[at:stop]
        at = stop


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    hashed = []
    for piece in _pieces(data):
        words = piece.lower().split()  # bytes: A-Z only, ASCII white space only
        hashed.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
    words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(len(words), SHINGLE)
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _WORD_FACTORS[i]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, borrowed where a bin is empty.  ``hashes`` is sorted and not empty."""
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[full] = hashes[first]
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    if len(empty):
        out[empty] = hashes[first][_LENDERS[empty][:, full].argmin(1)]
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band."""
    rows = signature(hashes).reshape(BANDS, ROWS)
    return _mix((rows * _ROW_FACTORS).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(flat))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, data): ``tid`` finds a text again without reading it in Python."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("data"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, n, digest, keys) per document: size and digest of its set and its bucket keys, none for an empty set."""
    texts = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for data in batch.column("data"):
                hashes = shingle_set(data.as_py())
                sizes.append(len(hashes))
                digests.append(hashlib.md5(hashes.tobytes()).digest())
                keys.append(band_keys(hashes) if len(hashes) else none)
            columns = [batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "n", "digest", "keys"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, tid long, n long, digest binary, keys array<long>")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, centre) of all buckets with two or more nodes; the centre is the least node."""
    rows = nodes.select("node", "n", F.explode("keys").alias("key")).repartition("key")
    centres = rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last")
    return rows.join(centres.select("key", "centre"), "key")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted``: one text of each is read again and its whole set computed."""
    chosen = nodes.join(wanted, "node").select("node", "digest", F.col("sample.tid").alias("tid"), F.col("sample.doc_id").alias("sample_id"))
    texts = _texts(docs, id_col, text_col)
    found = texts.join(chosen, (texts.tid == chosen.tid) & texts.doc_id.eqNullSafe(chosen.sample_id), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column("data")]
            digests = [hashlib.md5(h.tobytes()).digest() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(sets)], ["digest", "hashes"])

    sets = found.select("data").mapInArrow(run, "digest binary, hashes array<long>")
    once = sets.groupBy("digest").agg(F.first("hashes").alias("hashes"))  # a row may be there more than once
    return once.join(chosen, "digest").select("node", "hashes")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, both): the size of the intersection of two nodes' full sets, and the sum of their sizes."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    both = (F.size("left") + F.size("right")).cast("long")
    return pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("shared"), both.alias("both"))


def _near(shared, both, percent: int):
    return 100 * shared >= percent * (both - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The (a, b) whose full sets are similar enough."""
    return overlaps(pairs, sets).filter(_near(F.col("shared"), F.col("both"), percent)).select("a", "b")


def prefix_buckets(members: DataFrame, sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(key, node, n, rest) so that any two linked nodes among ``members`` (node, n) share a key, without exception.

    Shingles are ordered by the number of members that have them.  Two sets at the threshold share one of the first
    n - ceil(0.8 n) + 1 shingles of each in this order.  Shingles of one member come first and find nothing: a set with
    many of its own gets few keys or none.  ``rest`` counts a node's shingles that others have too, from the key on: two nodes
    whose first common key this is can't share more."""
    rows = members.select("node", "n").join(sets, "node").select("node", "n", F.explode("hashes").alias("key")).repartition("key")
    known = rows.groupBy("key").agg(F.count("*").alias("spread")).filter("spread > 1")
    several = rows.join(known, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("spread", "key"))).alias("keys"))
    several = several.withColumn("common", F.size("keys").cast("long"))
    length = F.col("common") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    several = several.filter(length > 0).select("node", "n", "common", F.posexplode(F.slice("keys", F.lit(1), length.cast("int"))).alias("at", "x"))
    return several.select(F.col("x.key").alias("key"), "node", "n", (F.col("common") - F.col("at")).alias("rest"))


def node_links(members: DataFrame, sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(node, root) that joins all nodes of one component, from the buckets of :func:`shared_buckets`."""
    sizes = members.select(F.col("node").alias("centre"), F.col("n").alias("centre_n")).distinct()
    star = members.filter("node != centre").select(F.col("centre"), "node", "n").distinct().join(sizes, "centre")
    near = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    tested = durable(star.filter(near).select(F.col("centre").alias("a"), F.col("node").alias("b")), "minhash-tested")
    links = durable(confirmed(tested, sets, percent), "minhash-links")
    roots = components(links)
    mixed = _mixed(members.select("key", "node", "n"), roots)
    left = durable(prefix_buckets(mixed.select("node", "n").distinct(), sets, percent), "minhash-left")
    centres = MORE_CENTRES
    while True:
        placed = durable(_mixed(left, roots), "minhash-mixed")
        if placed.isEmpty():
            return roots
        # What two nodes share lies in the main node of their bucket or in neither's part of it.
        hubs = overlaps(placed.select(F.col("main").alias("a"), F.col("node").alias("b")).distinct(), sets)
        hubs = hubs.select(F.col("a").alias("main"), F.col("b").alias("node"), F.col("shared").alias("held"))
        placed = durable(placed.join(hubs, ["main", "node"]), "minhash-placed")
        # Every open pair of a bucket has an end outside its largest component, so such nodes are centres.
        share, names = F.pmod(F.xxhash64("node"), F.lit(centres)).alias("share"), ("node", "n", "rest", "root", "held")
        chosen = placed.filter("root != main").groupBy("key", share).agg(F.min_by(F.struct(*names), "node").alias("centre"))
        chosen = durable(chosen.select("key", *(F.col(f"centre.{c}").alias(f"centre_{c}") for c in names)), "minhash-centres")
        outside = F.least(F.col("n") - F.col("held"), F.col("centre_n") - F.col("centre_held"))
        most = F.least("rest", "centre_rest", F.least("held", "centre_held") + outside)
        near = _near(most, F.col("n") + F.col("centre_n"), percent)
        pairs = placed.join(chosen, "key").filter((F.col("root") != F.col("centre_root")) & near)
        pairs = pairs.select(F.least("node", "centre_node").alias("a"), F.greatest("node", "centre_node").alias("b")).distinct()
        pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        found = durable(confirmed(pairs, sets, percent), "minhash-links")
        if not found.isEmpty():
            roots = _merged(roots, found)
        tested = tested.unionByName(pairs)
        done = chosen.select("key", F.col("centre_node").alias("node"))
        left = durable(placed.join(done, ["key", "node"], "left_anti").drop("root", "main", "held"), "minhash-left")
        centres *= MORE_CENTRES


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links, by joining the components at their ends."""
    first, second = (roots.select(F.col("node").alias(e), F.col("root").alias(f"{e}_root")) for e in ("a", "b"))
    ends = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = components(ends).withColumnRenamed("root", "new")
    old = roots.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    single = moved.select("node", F.col("new").alias("root")).join(roots, "node", "left_anti")
    return durable(old.unionByName(single), "minhash-roots")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets with nodes of several components, with each node's ``root`` and the bucket's largest one as ``main``."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts"))
    return placed.join(main.filter("parts > 1").select("key", "main"), "key")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept."""
    rows = durable(sketches(docs, id_col, text_col), "minhash-rows")
    nodes = rows.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("tid", "doc_id")).alias("sample"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")  # numbers are fixed once written
    members = durable(shared_buckets(nodes), "minhash-buckets")
    sets = durable(full_sets(docs, nodes, members.select("node").distinct(), id_col, text_col), "minhash-sets")
    roots = durable(node_links(members, sets, percent), "minhash-roots")
    placed = nodes.select("digest", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = durable(placed.join(least, "root").select("digest", "component_id"), "minhash-components")
    out = rows.select("doc_id", "n", "digest").join(placed, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
