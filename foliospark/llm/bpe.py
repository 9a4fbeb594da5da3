"""Byte-level BPE by rank files: two-tier encoding, and decoding.

A text is cut into pre-tokens.  Tier one: a minimal perfect hash over the vocabulary's byte strings tells, for all
distinct pre-tokens of an Arrow batch at once, which of them are tokens as they are.  Tier two: the misses are merged
over a linked list of bytes, with a heap of (rank, position) that gives the next pair; stale heap entries are skipped.

Texts are encoded whole; null and empty texts give no ids.  Repeated rows are encoded each.  Work per task is bounded by
one Arrow batch, cut by bytes, and by the pre-tokens of the longest text; nothing is shuffled.  Columns besides id and text are
not read.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BATCH_CHARS = 4_000_000
MEMO = 300_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class MinimalPerfectHash:
    """Maps n byte strings to 0..n-1 without gaps, by hash and displace.

    Keys fall into about n / 3 groups by one hash.  Each group, largest first, gets the smallest displacement that puts
    all its keys into free slots.  A look-up costs one hash, one displacement and one comparison of the stored hash.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.groups = len(keys), max(1, len(keys) // 3)
        h = _hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys must be distinct")
        self.shift = np.zeros(self.groups, np.uint64)
        self.owner = np.full(self.n, -1, np.int64)  # slot -> index into keys
        group = self._group(h).astype(np.int64)
        order = np.argsort(group, kind="stable")
        start = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in np.argsort(start[:-1] - start[1:], kind="stable"):
            members = order[start[g] : start[g + 1]]
            if not len(members):
                break
            base, d = 0, None
            while d is None:  # a block of displacements at a time
                tried = np.arange(base, base + 64, dtype=np.uint64)
                slots = self._slot(h[members][None, :], tried[:, None])
                free = (self.owner[slots] < 0).all(1)
                for i in np.flatnonzero(free):
                    if len(np.unique(slots[i])) == len(members):
                        d, where = tried[i], slots[i]
                        break
                base += 64
            self.shift[g], self.owner[where] = d, members

    def _group(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)) % np.uint64(self.groups)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * _M1)) * _M2
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key, the index of the only key it can be; the caller compares."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        h = _hashes(keys)
        return self.owner[self._slot(h, self.shift[self._group(h).astype(np.int64)])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a byte string by lowest-rank merges, leftmost first among equal ranks."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], after[i], alive[j] = stop, after[j], 0
        if after[i] < n:
            k = after[i]
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.words = list(self.ranks)
        self.word_ids = np.fromiter(self.ranks.values(), np.int64, len(self.words))
        self.table = MinimalPerfectHash(self.words)
        self.pieces = regex.compile(pattern).findall
        self.merged: dict[bytes, list[int]] = {}  # misses met lately, MEMO at most
        self.bytes_of = [b""] * (int(self.word_ids.max()) + 1)
        for word, i in self.ranks.items():
            self.bytes_of[i] = word

    def encode_distinct(self, pieces: list[str]) -> list[list[int]]:
        keys = [p.encode() for p in pieces]
        at = self.table.find(keys)
        words, ids = self.words, self.word_ids
        return [[int(ids[i])] if words[i] == k else self._merged(k) for k, i in zip(keys, at.tolist())]

    def _merged(self, key: bytes) -> list[int]:
        if (ids := self.merged.get(key)) is None:
            if len(self.merged) >= MEMO:
                self.merged.clear()
            ids = self.merged[key] = merge(key, self.ranks)
        return ids

    def encode_batch(self, texts: list[str]) -> Iterator[list[list[int]]]:
        """For each text, the id lists of its pre-tokens."""
        cut = [self.pieces(t) for t in texts]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, self.encode_distinct(distinct)))
        for pieces in cut:
            yield [ids[p] for p in pieces]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def by_chars(texts: Iterator[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about ``most`` characters; a longer text stands alone."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            at = 0
            for texts in by_chars(x.as_py() for x in batch.column("text")):
                ids = [np.concatenate([np.asarray(p, np.int32) for p in x]) if x else np.zeros(0, np.int32) for x in bpe.encode_batch(texts)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), lists], ["doc_id", "ids"])
                at += len(texts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        decimals = [str(i).encode() for i in range(len(bpe.bytes_of))]
        for batch in batches:
            out = []
            for texts in by_chars(x.as_py() for x in batch.column("text")):
                for pieces in bpe.encode_batch(texts):
                    ids = [i for p in pieces for i in p]
                    spelt = hashlib.sha256(b",".join(map(decimals.__getitem__, ids))).hexdigest()
                    out.append((len(ids), spelt, hashlib.sha256(bpe.decode(ids)).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            types = [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
