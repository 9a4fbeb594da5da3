"""Token id files: encode documents, write their ids range-coded, read them back.

A file holds, in ascending order of the documents' ids:

    magic | blocks | index | index length (8 bytes) | index checksum (4 bytes) | magic

A block is at most ``BLOCK_IDS`` ids, coded by ``idcoder`` on its own: its model starts empty and its CRC-32 over the ids
is kept in the index.  Blocks are large because their lanes, not their neighbours, are coded side by side.  The index is zlib-compressed and has, after three counts, (ids, bytes, checksum) per block and
(id, is null, ids) per document.  Documents run on through block borders; the end id closes each.

Documents are range-partitioned by id and sorted, one file per task.  A task holds ``GROUP_BLOCKS`` blocks at a time,
whatever the length of its documents.  Files are named by their writer and listed in a table when complete; readers get
the list, the number of ids before each file comes from a running sum over that list.

Null and empty texts have the end id only.  Null doc ids come first; rows that repeat an id are documents of their own.
Columns besides id and text are not read.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, fresh_path
from .common import text_or_empty
from .bpe import by_chars
from .files import new_file, open_file
from .idcoder import MAX_ID, decode_blocks, encode_blocks

MAGIC = b"IDSTRM02"
BLOCK_IDS, GROUP_BLOCKS = 1 << 22, 1
MEMO, MEMO_CHARS, LONG_WORD = 400_000, 8_000_000, 256
SLICE, LINE = 2_000, 50
SPLIT_CHARS = 1_000_000
END_ID = 0
_END = (END_ID,)  # no word
#: White space that needs its neighbours: a text that has any is cut at plain borders only.
_ODD_SPACE = re.compile(r"[\s](?:(?<= )\s|(?<!\n)[ \n]|(?<=\n)(?:[^\S\n]|\n(?!\S)))").search
_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)").split
_PROBE, _PROBE_PIECES = "a b\n1 ,\n\nb", ["a", " b", "\n", "1", " ,", "\n", "\n", "b"]


def _checksum(ids: np.ndarray, start: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), start)


class IdFileWriter:
    """Writes documents' ids to a binary stream."""

    def __init__(self, out):
        self.out, self.size, self.total = out, out.write(MAGIC), 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and ids.max() >= MAX_ID:
            raise ValueError("the vocabulary has ids over 65535")
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.total += len(ids)
        for at in range(0, len(ids), BLOCK_IDS * GROUP_BLOCKS):
            part = ids[at : at + BLOCK_IDS * GROUP_BLOCKS].astype(np.uint16)
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held >= BLOCK_IDS * GROUP_BLOCKS:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held)
        most = len(ids) if last else GROUP_BLOCKS * BLOCK_IDS
        blocks = [ids[i : min(i + BLOCK_IDS, most)] for i in range(0, most, BLOCK_IDS)]
        for block, code in zip(blocks, encode_blocks(blocks)):
            self.size += self.out.write(code)
            self.blocks.append((len(block), len(code), _checksum(block)))
        self.held, self.n_held = [ids[most:]], len(ids) - most

    def close(self) -> None:
        if self.n_held:
            self._flush(True)
        parts = [np.array(self.blocks, "<u4").reshape(-1, 3).tobytes(), *(struct.pack("<q?q", *d) for d in self.docs)]
        index = zlib.compress(struct.pack("<qqq", len(self.blocks), len(self.docs), self.total) + b"".join(parts))
        self.size += self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)


def read_id_file(stream) -> Iterator[tuple[int | None, list[np.ndarray] | None, np.ndarray]]:
    """(doc_id, document is complete, ids) pieces in order; a document may come in several pieces.  ValueError if a
    checksum differs."""
    size = stream.seek(0, 2)
    stream.seek(size - 20)
    length, check, magic = struct.unpack("<QI8s", stream.read(20))
    stream.seek(size - 20 - length)
    packed = stream.read(length)
    stream.seek(0)
    if magic != MAGIC or stream.read(8) != MAGIC or zlib.crc32(packed) != check:
        raise ValueError("not a complete id file")
    index = zlib.decompress(packed)
    n_blocks, n_docs, _ = struct.unpack_from("<qqq", index)
    blocks = np.frombuffer(index, "<u4", n_blocks * 3, 24).reshape(-1, 3)
    docs = struct.iter_unpack("<q?q", index[24 + 12 * n_blocks :])
    doc_id, left = None, 0
    for g in range(0, n_blocks, GROUP_BLOCKS):
        group = blocks[g : g + GROUP_BLOCKS]
        decoded = decode_blocks([stream.read(int(b)) for b in group[:, 1]], group[:, 0])
        if any(_checksum(d) != c for d, c in zip(decoded, group[:, 2])):
            raise ValueError("block checksum differs")
        ids = np.concatenate(decoded)
        at = 0
        while at < len(ids):
            if not left:
                number, is_null, left = next(docs)
                doc_id = None if is_null else number
            part = ids[at : at + left]
            at, left = at + len(part), left - len(part)
            yield doc_id, not left, part


class _Numbers(dict):
    """Gives each new key the next number and keeps it for ``take_new``."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


class LibraryTokenizer:
    """The tokenizers library over distinct words: cut before each single space or line end between other characters, a text
    falls into words that the library's pattern cuts there too, so the ids of a text are those of its words in turn.  New
    words go to the library as lines of many, and the lengths of its tokens tell whose they are.  Added tokens are cut out
    of a text first, longest first, as the library does; each is a word of its own."""

    def __init__(self, path: str, pattern: str):
        import os

        import regex

        # Spark runs a task per core; the library's own threads would add memory for each of them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(pattern).findall
        if self.pieces(_PROBE) != _PROBE_PIECES:
            raise ValueError("a pattern that joins words over white space")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that depend on their neighbours")
        longest = sorted((t.content for t in added), key=len, reverse=True)
        self.added = regex.compile(f"({'|'.join(map(regex.escape, longest))})") if longest else None
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= MAX_ID:
            raise ValueError("the vocabulary has ids over 65535")
        #: Bytes of each token: a byte-level vocabulary spells them in one character each.
        self.n_bytes = np.zeros(MAX_ID, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._forget()

    def _forget(self) -> None:
        #: The number of each known word; where its ids begin in ``ids``, and how many they are.
        self.known = _Numbers({_END: 0})
        self.ids, self.starts, self.sizes = np.array([END_ID], np.uint16), np.array([0]), np.array([1])
        self.n_chars = 0

    def cut(self, text: str) -> list[str | tuple]:
        """Words without the space before them; those that have neither that nor a line end in front are in tuples."""
        if self.added and self.added.search(text):
            parts = self.added.split(text)  # every second one is an added token
            return [w for k, part in enumerate(parts) for w in ([(part,)] if k % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str | tuple]:
        if _ODD_SPACE(text):
            first, *words = _BORDER(text)
            words = [w[1:] if w[0] == " " else w for w in words]
        else:
            first, *words = text.replace("\n", " \n").split(" ")
        if words and max(map(len, words)) > LONG_WORD:
            words = [p for w in words for p in (self._pieces(w if w[:1] == "\n" else " " + w) if len(w) > LONG_WORD else [w])]
        return [*(self._pieces(first) if len(first) > LONG_WORD else [(first,)] if first else []), *words]

    def _pieces(self, word: str) -> list[tuple]:
        """A long word by the pattern, so that texts without spaces don't fill the memo or the library's results."""
        return [(piece,) for piece in self.pieces(word)]

    def _learn(self, words: list[str | tuple]) -> None:
        self.n_chars += sum(len(w[0]) if type(w) is tuple else len(w) for w in words)
        # Words in tuples, and those with white space inside or behind, would not stand alone in a line.
        alone = [type(w) is tuple or not w or " " in w or "\n" in w[1:] or w[-1].isspace() for w in words]
        rest = [i for i, x in enumerate(alone) if x]
        plain = [i for i, x in enumerate(alone) if not x] if rest else range(len(words))
        found, in_turn, sizes = [self.ids], [], []
        for at in range(0, len(plain), SLICE):  # the library's results are large
            part = plain[at : at + SLICE]
            given = [words[i] for i in part]
            lines = [" " + " ".join(given[i : i + LINE]) for i in range(0, len(given), LINE)]
            lines = [x.replace(" \n", "\n") for x in lines]
            ids = np.fromiter(chain.from_iterable([e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]), np.uint16)
            spelt = np.frombuffer("".join(lines).encode(), np.uint8)
            ends = np.append(np.flatnonzero((spelt == 32) | (spelt == 10))[1:], len(spelt))
            upto = self.n_bytes.take(ids).cumsum()
            last = np.searchsorted(upto, ends)
            if len(ends) != len(part) or not np.array_equal(upto.take(last, mode="clip"), ends):  # not all bytes are spelt out
                rest += part
                continue
            found.append(ids)
            in_turn.append(np.array(part))
            sizes.append(np.diff(last, prepend=-1))
        for at in range(0, len(rest), SLICE):
            part = rest[at : at + SLICE]
            texts = [w[0] if type(w := words[i]) is tuple else w if w[:1] == "\n" else " " + w for i in part]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(got), np.uint16))
            in_turn.append(np.array(part))
            sizes.append(np.array([len(x) for x in got]))
        size = np.concatenate(sizes)
        start = np.empty((2, len(words)), np.int64)
        start[:, np.concatenate(in_turn)] = len(self.ids) + size.cumsum() - size, size
        self.ids = np.concatenate(found)
        self.starts, self.sizes = np.append(self.starts, start[0]), np.append(self.sizes, start[1])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.known) > MEMO or self.n_chars > MEMO_CHARS:
            self._forget()
        cut = [[*self.cut(t), _END] for t in texts]
        counts = [len(c) for c in cut]
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int32, sum(counts))
        if new := self.known.take_new():
            self._learn(new)
        start, size = self.starts.take(number), self.sizes.take(number)
        upto = size.cumsum()
        ids = self.ids.take(np.repeat(start - upto + size, size) + np.arange(size.sum())).astype(np.int32)
        ends = upto.take(np.cumsum(counts, dtype=np.int64) - 1)
        yield from np.split(ids, ends[:-1]) if cut else ()


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write id files under ``folder``; the table of the files: part, uri, n_ids, n_docs, bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        tokenizer = LibraryTokenizer(path, pattern)
        with new_file(folder, ".ids") as (out, uri):
            file = IdFileWriter(out)
            for batch in chain([first], batches):
                ids = iter(batch.column("doc_id").to_pylist())
                for texts in by_chars((x.as_py() for x in batch.column("text")), SPLIT_CHARS):
                    for found in tokenizer.encode(texts):
                        file.add(next(ids), found)
            file.close()
        row = {"part": [TaskContext.get().partitionId()], "uri": [uri], "n_ids": [file.total], "n_docs": [len(file.docs)], "bytes": [file.size]}
        yield pa.RecordBatch.from_pydict(row)

    return durable(rows.mapInArrow(write, "part long, uri string, n_ids long, n_docs long, bytes long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    earlier = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    named = files.select("uri", F.coalesce(earlier, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                rows, n, check = [], 0, 0
                with open_file(uri) as stream:
                    for doc_id, complete, ids in read_id_file(stream):
                        n, check = n + len(ids), _checksum(ids, check)
                        if complete:
                            rows.append((doc_id, start, n, check))
                            start, n, check = start + n, 0, 0
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.repartition(max(1, files.count()), "uri").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write all documents, read them back."""
    return read_token_files(write_token_files(docs, fresh_path(docs.sparkSession, "ids"), path, pattern))
