"""Suffix-array dedup: remove bytes covered by a long string that an earlier document also has.

A byte goes if some ``MIN_BYTES`` long string that covers it also starts in a document with a smaller id.  In suffix
order, strings that agree in their first MIN_BYTES bytes stand together.  The previous and the next position that belong
to a smaller document give the longest previous factor; where it reaches MIN_BYTES, the string is a later copy.

A suffix array over the whole corpus would need all suffixes in one order.  Here suffixes are first dealt out so that
equal strings meet: every string of MIN_BYTES bytes has a minimizer, the ``GRAM`` bytes in it with the least hash, which
depends on the string alone.  About one position in sixteen is such an anchor.

1. Texts are packed into chunks of about ``CHUNK_BYTES``, longer ones are cut (written once; all later steps speak of
   positions in chunks).
2. Each chunk sends the distinct hashes of its anchors; hashes that two chunks have are sent back.
3. Each chunk builds the suffix array of the strings around anchors that repeat inside it and settles these copies at
   once.  For strings it is the first to have, around anchors that other chunks have too, it sends the bytes, dealt by
   anchor.  However frequent a passage, a chunk sends it once, also if one document repeats it: then only the other
   places go along.
4. Each bucket of anchors builds the suffix array of the strings it got and reports the later copies.
5. Each chunk removes what 3 and 4 have found.

Null and empty texts, and texts below MIN_BYTES, keep all bytes.  Ids that are equal are not smaller than each other, so
repeated rows do not remove each other; a null id counts as larger than any other.  Matches never cross documents.
A text of more than a chunk is cut into pieces, each with the first MIN_BYTES - 1 bytes of the next one, so that every string
lies in just one piece; the pieces are chunks of their own, and what they keep is put together in order.  A task then needs
some 30 bytes for each byte of a chunk, whatever a text's length.  Input columns other than id and text are not read.
Empty tables give empty results.

A passage that very many chunks have would meet in one bucket.  Anchors that more than ``FAN`` chunks have are compared in a
tree: ``FAN`` chunks at a time, and only strings that no smaller document has there go on to the next level.  No task gets
more than FAN chunks' share of an anchor, however large the corpus; only rows that repeat an id, or have none, cannot settle
each other and go on together.
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

MIN_BYTES = 50
GRAM = 20
WINDOW = MIN_BYTES - GRAM + 1  # grams in a string
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
FAN = 1024
COMPARE_AT_ONCE = 1 << 18
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 9)


def _shrink(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec().compress(data, asbytes=True)


def _restore(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _codec().decompress(data[8:], size, asbytes=True) if size else b""


def _pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as their differences, byte by byte, so that the leading zeros vanish."""
    return _shrink(np.diff(h, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_restore(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


# --- anchors of one chunk ---


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 20 bytes that start at each position but the last 19."""
    two = x[:-1].astype(_U) << _U(8) | x[1:]
    four = two[:-2] << _U(16) | two[2:]
    del two
    eight = four[:-4] << _U(32) | four[4:]
    n = len(x) - GRAM + 1
    h = eight[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h += eight[8 : 8 + n]
    h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h += four[16 : 16 + n]
    h *= _U(0x165667B19E3779F9)
    h ^= h >> _U(32)
    return h


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i : i + width] for every full window."""
    n, have = len(a) - width + 1, 1
    while have * 2 <= width:
        a = best(a[:-have], a[have:])
        have *= 2
    return best(a[:n], a[width - have : width - have + n]) if have < width else a[:n]


def _window_starts(ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions at which a string of MIN_BYTES fits into its document; length size - MIN_BYTES + 1."""
    ok = np.ones(max(0, size - MIN_BYTES + 1), bool)
    for k in range(1, MIN_BYTES):
        at = ends - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


class Anchors:
    """Minimizers of a chunk: ``at`` (positions), ``hash`` and ``owner`` (index of the document)."""

    def __init__(self, x: np.ndarray, ends: np.ndarray):
        self.x, self.ends = x, ends
        self.at = np.zeros(0, np.int64)
        if len(x) >= MIN_BYTES:
            h = gram_hashes(x)
            self.least = _sliding(h, WINDOW, np.minimum)  # per string
            self.fits = _window_starts(ends, len(x))
            self.least[~self.fits] = 0
            pad = np.zeros(WINDOW - 1, _U)
            reach = _sliding(np.concatenate([pad, self.least, pad]), WINDOW, np.maximum)
            self.at = np.flatnonzero((reach == h) & (h > 0))
            self.raw = h[self.at]
        else:
            self.raw = np.zeros(0, _U)
        # Minimizers have small hashes; mixed again (one to one) they spread evenly over buckets.
        mixed = self.raw * _U(0xD6E8FEB86659FD93)
        self.hash = mixed ^ (mixed >> _U(32))
        self.hash *= _U(0xD6E8FEB86659FD93)
        self.owner = np.searchsorted(ends, self.at, side="right")

    def strings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings whose minimizer is among the anchors in the mask, and the index of that anchor."""
        if not wanted.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(len(self.x) + 1, np.int32)
        np.add.at(edge, np.maximum(self.at[wanted] - (WINDOW - 1), 0), 1)
        np.add.at(edge, self.at[wanted] + 1, -1)
        near = np.flatnonzero((np.cumsum(edge)[: len(self.fits)] > 0) & self.fits)
        k = np.searchsorted(self.at, near)
        while True:  # the first anchor of the string that has its least hash
            other = np.flatnonzero(self.raw[k] != self.least[near])
            if not len(other):
                break
            k[other] += 1
        take = wanted[k]
        return near[take], k[take]


def later_copies(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the strings (rows of MIN_BYTES bytes) that a document with a smaller id also has.

    Suffix order, then for each place the nearest places before and after it with a smaller document, found by
    following pointers over places with larger ones.  On the way the least common prefix, cut at MIN_BYTES, is carried.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, bool)
    keys = np.ascontiguousarray(strings).view(f"S{MIN_BYTES}").ravel()
    order = np.argsort(keys, kind="stable")
    doc = doc[order]
    full = np.zeros(n + 1, bool)  # place i agrees with i - 1 in MIN_BYTES bytes
    for s in range(1, n, COMPARE_AT_ONCE):
        part = keys[order[s - 1 : s + COMPARE_AT_ONCE]]
        full[s : s + len(part) - 1] = part[1:] == part[:-1]
    found = np.zeros(n, bool)
    for step in (-1, 1):
        link = np.arange(n) + step
        agree = full[:-1].copy() if step < 0 else full[1:].copy()
        todo = np.flatnonzero(agree)  # a shorter prefix can't grow again
        while len(todo):
            to = link[todo]
            smaller = doc[to] < doc[todo]
            found[todo[smaller]] = True
            todo, to = todo[~smaller], to[~smaller]
            new_agree, new_link = agree[to], link[to]
            agree[todo], link[todo] = new_agree, new_link
            todo = todo[new_agree]
    out = np.zeros(n, bool)
    out[order] = found
    return out


def _runs(starts: np.ndarray) -> np.ndarray:
    """(first, count) of runs of consecutive sorted numbers, flat."""
    if not len(starts):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    return np.stack([starts[first], np.diff(np.r_[first, len(starts)])], 1).ravel()


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in turn."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _bytes_at(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, MIN_BYTES)[starts]


def _repeated_within(a: Anchors) -> np.ndarray:
    """Mask of the anchors whose hash two documents of the chunk have."""
    order = np.lexsort((a.owner, a.hash))
    h, o = a.hash[order], a.owner[order]
    differ = (h[1:] == h[:-1]) & (o[1:] != o[:-1])
    return np.isin(a.hash, np.unique(h[1:][differ]))


def _repeated(h: np.ndarray) -> np.ndarray:
    """Mask of the values that occur more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(h) else same
    return out


def _first_equal(x: np.ndarray, start: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """For each string, the index of the first equal one; only those in the mask can have others."""
    out = np.arange(len(start))
    at = np.flatnonzero(maybe)
    if len(at):
        keys = _bytes_at(x, start[at]).view(f"S{MIN_BYTES}").ravel()
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        out[at[order]] = at[order[head]]
    return out


# --- steps over the table ---


class _Chunk:
    def __init__(self, ids: bytes, lengths: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.cumsum(np.frombuffer(lengths, np.int64))
        self.x = np.frombuffer(_restore(data), np.uint8)
        self.anchors = Anchors(self.x, self.ends)


def _pieces(text: pa.Buffer, step: int) -> Iterator[tuple[bytes, bool]]:
    """Pieces of a text, ``step`` strings each, and whether one is the last."""
    at, size = 0, text.size
    while True:
        last = at + step + (MIN_BYTES - 1) >= size
        yield text.slice(at, min(step + (MIN_BYTES - 1), size - at)).to_pybytes(), last
        if last:
            return
        at += step


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, lengths, nulls, data, seat, part, last): about ``chunk_bytes`` of text a row.  No shuffle.

    A row holds whole documents, or one piece of a longer one: ``seat`` then names the document, ``part`` counts its pieces."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"), F.monotonically_increasing_id().alias("seat")
    )
    kinds = pa.schema([(n, pa.binary()) for n in ("ids", "lengths", "nulls", "data")] + [("seat", pa.int64()), ("part", pa.int64()), ("last", pa.bool_())])

    def row(ids: list[int | None], texts: list[bytes], seat=None, part=None, last=None) -> pa.RecordBatch:
        numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        nulls = np.array([i is None for i in ids])
        made = [numbers.tobytes(), lengths.tobytes(), nulls.tobytes(), _shrink(b"".join(texts)), seat, part, last]
        return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(kinds, made)}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, t, seat in zip(batch.column("doc_id").to_pylist(), batch.column("data"), batch.column("seat").to_pylist()):
                text = t.as_buffer()
                if text.size > chunk_bytes:
                    for part, (piece, last) in enumerate(_pieces(text, chunk_bytes)):
                        yield row([i], [piece], seat, part, last)
                    continue
                ids.append(i)
                texts.append(text.to_pybytes())
                size += text.size
                if size >= chunk_bytes or len(ids) >= chunk_bytes // 16:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    packed = rows.mapInArrow(run, "ids binary, lengths binary, nulls binary, data binary, seat long, part long, last boolean")
    return durable(packed.withColumn("chunk", F.monotonically_increasing_id()), "suffix-chunks")


def _spread(rows: DataFrame, column: str, tasks: int) -> DataFrame:
    """Rows of packed bytes dealt by a column; their number says little, so the number of tasks is given."""
    return rows.repartition(tasks, column).sortWithinPartitions(column)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one value of a sorted column at a time."""
    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r[column] != now:
                yield now, held
                held = []
            now = r[column]
            held.append(r)
    if held:
        yield now, held


def shared_hashes(chunks: DataFrame, buckets: int, fan: int | None = None) -> DataFrame:
    """(chunk, hashes, hot): for each chunk, its anchors' hashes that another chunk has too, and those that more than ``fan``
    chunks have (null without ``fan``)."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h = np.unique(_Chunk(r["ids"], r["lengths"], r["data"]).anchors.hash)
                bucket = _bucket_of(h, buckets)
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else []
                parts = np.split(h, edges[1:]) if len(h) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges], pa.int64()) if len(h) else pa.array([], pa.int64()), pa.array([r["chunk"]] * len(parts), pa.int64()), pa.array([_pack_hashes(p) for p in parts], pa.binary())],
                    ["bucket", "chunk", "hashes"],
                )

    def compare(batches):
        for _, rows in _groups(batches, "bucket"):
            parts = [_unpack_hashes(r["hashes"]) for r in rows]
            h = np.concatenate(parts)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            shared = np.zeros(len(h), bool)
            shared[order] = np.r_[same, False] | np.r_[False, same]
            at = np.cumsum([0, *map(len, parts)])
            hot = np.zeros(len(h), bool)
            if fan is not None and len(h):  # a chunk sends a hash once
                run = np.cumsum(np.r_[True, ~same]) - 1
                hot[order] = np.bincount(run)[run] > fan
            out = [
                (r["chunk"], _pack_hashes(p[shared[s:e]]), _pack_hashes(p[hot[s:e]]) if hot[s:e].any() else None)
                for r, p, s, e in zip(rows, parts, at, at[1:])
                if shared[s:e].any()
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "hashes", "hot"])

    sent = chunks.mapInArrow(send, "bucket long, chunk long, hashes binary")
    return _spread(sent, "bucket", buckets).mapInArrow(compare, "chunk long, hashes binary, hot binary")


def _unpacked(parts: list[bytes] | None) -> np.ndarray:
    return np.concatenate([_unpack_hashes(b) for b in parts or []] or [np.zeros(0, _U)])


def _node(chunk: int, nodes: int) -> int:
    return ((chunk * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % nodes


def chunk_copies(chunks: DataFrame, shared: DataFrame, buckets: int, nodes: int = 1) -> DataFrame:
    """(bucket, chunk, runs, strings): ``runs`` of copies settled inside a chunk, or ``strings`` for a bucket to compare.

    Numbers from ``buckets`` on are the lowest nodes of the trees of hot anchors: bucket + buckets * (1 + node)."""
    lists = shared.groupBy("chunk").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("hot").alias("hot"))
    both = chunks.drop("nulls", "seat", "part", "last").join(lists, "chunk", "left")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                c = _Chunk(r["ids"], r["lengths"], r["data"])
                a = c.anchors
                elsewhere = np.isin(a.hash, _unpacked(r["hashes"]))
                place = _bucket_of(a.hash, buckets)
                if r["hot"]:
                    place[np.isin(a.hash, _unpacked(r["hot"]))] += buckets * (1 + _node(r["chunk"], nodes))
                here = _repeated_within(a) if len(a.at) else elsewhere
                start, k = a.strings(here | elsewhere)
                doc = c.ids[np.searchsorted(c.ends, start, side="right")]
                settled = np.zeros(len(start), bool)
                local = np.flatnonzero(here[k])
                settled[local] = later_copies(_bytes_at(c.x, start[local]), doc[local]) if len(local) else False
                out = [(r["chunk"] % buckets, r["chunk"], _runs(start[settled]).astype("<i8").tobytes(), None)] if settled.any() else []
                rest = ~settled & elsewhere[k]
                start, k, doc = start[rest], k[rest], doc[rest]
                if len(start):
                    same = _first_equal(c.x, start, _repeated(a.hash)[k])
                    again = np.flatnonzero(same != np.arange(len(same)))
                    sent = np.flatnonzero(same == np.arange(len(same)))
                    first = np.flatnonzero(np.r_[True, (np.diff(start[sent]) != 1) | (np.diff(k[sent]) != 0)])
                    count = np.diff(np.r_[first, len(sent)])
                    first = sent[first]
                    bucket, bucket_again = place[k[first]], place[k[again]]
                    order, order_again = np.argsort(bucket, kind="stable"), np.argsort(bucket_again, kind="stable")
                    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
                    for piece in np.split(order, edges[1:]):
                        b = int(bucket[piece[0]])
                        s, n = start[first[piece]], count[piece]
                        low, high = np.searchsorted(bucket_again[order_again], [b, b + 1])
                        more = again[order_again[low:high]]
                        numbers = [np.int64([len(piece), len(more)]), s, n, doc[first[piece]], start[more], start[same[more]]]
                        text = c.x[_ranges(s, n + (MIN_BYTES - 1))]
                        packed = b"".join(x.astype(np.int64).tobytes() for x in numbers) + text.tobytes()
                        out.append((b, r["chunk"], None, _shrink(packed)))
                columns = list(zip(*out)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["bucket", "chunk", "runs", "strings"])

    return both.mapInArrow(run, "bucket long, chunk long, runs binary, strings binary")


def _survivors(starts: np.ndarray, docs: np.ndarray, at: np.ndarray, x: np.ndarray, again: np.ndarray, first: np.ndarray) -> bytes:
    """Strings that go on, packed as they came: runs of neighbours, with the other places of each."""
    new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(at) != 1) | (np.diff(docs) != 0)])
    count = np.diff(np.r_[new, len(starts)])
    numbers = [np.int64([len(new), len(again)]), starts[new], count, docs[new], again, first]
    text = x[_ranges(at[new], count + (MIN_BYTES - 1))]
    return _shrink(b"".join(n.astype(np.int64).tobytes() for n in numbers) + text.tobytes())


def _compared(rows: list[dict], go_on: bool) -> Iterator[tuple[int, bytes | None, bytes | None]]:
    """(chunk, runs, strings): the later copies among the strings of one bucket or node, and, if asked, the others."""
    texts, starts, docs, at, more, offset = [], [], [], [], [], 0
    for r in rows:
        raw = _restore(r["strings"])
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        s, count, doc = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(3, n)
        text = np.frombuffer(raw, np.uint8, offset=16 + 24 * n + 16 * m).copy()
        size = count + (MIN_BYTES - 1)
        at.append(_ranges(offset + np.cumsum(size) - size, count))
        starts.append(_ranges(s, count))
        docs.append(np.repeat(doc, count))
        more.append(np.frombuffer(raw, np.int64, 2 * m, 16 + 24 * n).reshape(2, m).copy())
        texts.append(text)
        offset += len(text)
    x = np.concatenate(texts)
    copy = later_copies(_bytes_at(x, np.concatenate(at)), np.concatenate(docs))
    edge = np.cumsum([0, *map(len, starts)])
    for r, s, d, p, (again, first), i, j in zip(rows, starts, docs, at, more, edge, edge[1:]):
        gone = copy[i:j]
        also = np.isin(first, s[gone])
        if gone.any():
            yield r["chunk"], _runs(np.sort(np.concatenate([s[gone], again[also]]))).astype("<i8").tobytes(), None
        if go_on and not gone.all():
            yield r["chunk"], None, _survivors(s[~gone], d[~gone], p[~gone], x, again[~also], first[~also])


def bucket_copies(found: DataFrame, buckets: int, fan: int = FAN, depth: int = 1) -> DataFrame:
    """(chunk, runs): all copies, those settled before and those that buckets and the ``depth`` levels of trees find."""

    def level(rows: DataFrame, step: int) -> DataFrame:
        def run(batches):
            for place, group in _groups(batches, "bucket"):
                out = [(place, r["chunk"], r["runs"], None) for r in group if r["runs"] is not None]
                if group := [r for r in group if r["strings"] is not None]:
                    go_on, up = place >= buckets and step < depth, place
                    if go_on:
                        up = place % buckets + buckets * (1 + (place // buckets - 1) % fan ** (depth - 1 - step))
                    out += [(up, *found) for found in _compared(group, go_on)]
                if out:
                    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["bucket", "chunk", "runs", "strings"])

        return _spread(rows, "bucket", buckets).mapInArrow(run, "bucket long, chunk long, runs binary, strings binary")

    found = level(found, 1)
    settled = None
    for step in range(2, depth + 1):  # what is settled stays where it is
        found = durable(found, "suffix-level")
        done = found.filter("runs IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        found = level(found.filter("strings IS NOT NULL"), step)
    return (found if settled is None else settled.unionByName(found)).select("chunk", "runs")


class _Report:
    """What is left of a document, taken in piece by piece."""

    FIELDS = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}

    def __init__(self):
        self.bytes = self.removed = self.spans = 0
        self.open = False  # the last byte was removed
        self.kept = hashlib.sha256()

    def add(self, x: np.ndarray, gone: np.ndarray) -> None:
        if not len(x):
            return
        self.bytes += len(x)
        self.removed += int(gone.sum())
        self.spans += int((gone & ~np.r_[self.open, gone[:-1]]).sum())
        self.open = bool(gone[-1])
        self.kept.update(x[~gone].tobytes())

    def row(self, doc_id: int | None) -> dict:
        return {"doc_id": doc_id, "n_bytes": self.bytes, "n_removed": self.removed, "n_spans": self.spans, "kept_sha256": self.kept.hexdigest()}


class _Text:
    """The bytes that are left."""

    FIELDS = {"doc_id": "long", "data": "binary"}

    def __init__(self):
        self.kept: list[bytes] = []

    def add(self, x: np.ndarray, gone: np.ndarray) -> None:
        self.kept.append(x[~gone].tobytes())

    def row(self, doc_id: int | None) -> dict:
        return {"doc_id": doc_id, "data": b"".join(self.kept)}


def _arrow(fields: dict) -> pa.Schema:
    return pa.schema([(n, pa.type_for_alias({"long": "int64", "boolean": "bool"}.get(k, k))) for n, k in fields.items()])


def _ddl(fields: dict) -> str:
    return ", ".join(f"{n} {k}" for n, k in fields.items())


_PIECE = {"doc_id": "long", "seat": "long", "part": "long", "last": "boolean", "data": "binary", "gone": "binary"}


def _marked(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk and the mask of those that go."""
    x = np.frombuffer(_restore(r["data"]), np.uint8)
    edge = np.zeros(len(x) + 1, np.int32)
    for b in r["runs"] or []:
        first, count = np.frombuffer(b, "<i8").reshape(-1, 2).T
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + (MIN_BYTES - 1), -1)
    return x, np.cumsum(edge[:-1]) > 0


def _joined(pieces: DataFrame, kind: type) -> DataFrame:
    """Rows of documents that were cut: their pieces are streamed in order, one at a time."""
    kinds = _arrow(kind.FIELDS)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    whole, over = kind(), np.zeros(0, bool)
                x, gone = np.frombuffer(_restore(r["data"]), np.uint8), np.frombuffer(_restore(r["gone"]), bool).copy()
                gone[: len(over)] |= over
                own = len(x) if r["last"] else len(x) - (MIN_BYTES - 1)
                over = gone[own:]
                whole.add(x[:own], gone[:own])
                if r["last"]:
                    yield pa.RecordBatch.from_pylist([whole.row(r["doc_id"])], kinds)

    return pieces.repartition("seat").sortWithinPartitions("seat", "part").mapInArrow(run, _ddl(kind.FIELDS))


def _kept_rows(chunks: DataFrame, copies: DataFrame, kind: type) -> DataFrame:
    """One row of ``kind`` for every document."""
    both = chunks.join(copies.groupBy("chunk").agg(F.collect_list("runs").alias("runs")), "chunk", "left")
    cut = not chunks.filter("seat IS NOT NULL").select("seat").isEmpty()
    fields = {**kind.FIELDS, **{f"piece_{n}": k for n, k in _PIECE.items()}} if cut else kind.FIELDS
    kinds = _arrow(fields)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, gone = _marked(r)
                ids = [None if null else int(i) for i, null in zip(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], bool))]
                if r["seat"] is not None:
                    piece = {"doc_id": ids[0], "seat": r["seat"], "part": r["part"], "last": r["last"], "data": r["data"], "gone": _shrink(gone.tobytes())}
                    yield pa.RecordBatch.from_pylist([{f"piece_{n}": v for n, v in piece.items()}], kinds)
                    continue
                ends = np.cumsum(np.frombuffer(r["lengths"], np.int64))
                out = []
                for i, s, e in zip(ids, np.r_[0, ends], ends):
                    whole = kind()
                    whole.add(x[s:e], gone[s:e])
                    out.append(whole.row(i))
                yield pa.RecordBatch.from_pylist(out, kinds)

    made = both.mapInArrow(run, _ddl(fields))
    if not cut:
        return made
    made = durable(made, "suffix-kept")
    pieces = made.filter("piece_seat IS NOT NULL").select(*[F.col(f"piece_{n}").alias(n) for n in _PIECE])
    return made.filter("piece_seat IS NULL").select(*kind.FIELDS).unionByName(_joined(pieces, kind))


def tree_depth(chunks: int, fan: int) -> int:
    """Levels at which ``fan`` at a time become one."""
    depth = 1
    while fan**depth < chunks:
        depth += 1
    return depth


def _copies(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, bucket_bytes: int, fan: int) -> tuple[DataFrame, DataFrame]:
    chunks = pack_chunks(docs, id_col, text_col, chunk_bytes)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    buckets = max(16, -(-size // bucket_bytes))
    depth = tree_depth(chunks.count(), fan)
    shared = shared_hashes(chunks, buckets, fan if depth > 1 else None)
    return chunks, bucket_copies(chunk_copies(chunks, shared, buckets, fan ** (depth - 1)), buckets, fan, depth)


def dedup_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _kept_rows(*_copies(docs, id_col, text_col, chunk_bytes, bucket_bytes, fan), _Report)


def remove_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN
) -> DataFrame:
    """One row per document: doc_id and ``data``, the remaining bytes (removal may cut a character in two)."""
    return _kept_rows(*_copies(docs, id_col, text_col, chunk_bytes, bucket_bytes, fan), _Text)
