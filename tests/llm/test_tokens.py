import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from edge_rows import empty, rows, table
from tokenizers import Tokenizer

from foliospark.llm import bpe, idcoder, token_files, warc

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBpe(MULTI, P.PATTERN)


# --- byte-level BPE ---


def test_round_trip_equals_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows():
        ids = library.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = bpe.round_trip(table(spark), MULTI, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    encoded = bpe.encode_documents(table(spark), MULTI, P.PATTERN).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in encoded) == sorted(w[:2] for w in want)
    assert bpe.round_trip(empty(spark), MULTI, P.PATTERN).count() == 0


def test_merges_on_random_bytes(codec):
    ranks = codec.ranks
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aabe theéß日🎉 \n01") for _ in range(rng.randint(1, 60)))
        if text.encode() not in ranks:
            assert bpe.merge(text.encode(), ranks) == library.encode_ordinary(text)


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.table.owner.tolist()) == list(range(len(codec.words)))
    found = codec.table.find(codec.words)
    assert found.tolist() == list(range(len(codec.words)))
    assert bpe.MinimalPerfectHash([]).find([b"x"]).tolist() == [-1]
    with pytest.raises(ValueError):
        bpe.MinimalPerfectHash([b"a", b"a"])


# --- the id coder ---


@pytest.mark.parametrize("seed", range(8))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    top = [2, 40, 5000, 65536][seed % 4]
    blocks = [rng.integers(0, top, int(rng.integers(0, 400))) for _ in range(25)] + [np.full(900, top - 1), np.arange(300) % top]
    codes = idcoder.encode_blocks(blocks)
    back = idcoder.decode_blocks(codes, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert idcoder.encode_blocks(blocks[3:4])[0] == codes[3]  # blocks do not depend on their neighbours


def test_coder_learns_and_checks_range():
    repeated = np.tile(np.arange(7) * 1000, 500)
    assert len(idcoder.encode_blocks([repeated])[0]) < len(repeated) / 8
    with pytest.raises(ValueError):
        idcoder.encode_blocks([np.array([1 << 16])])
    assert idcoder.encode_blocks([]) == [] and idcoder.decode_blocks([], []) == []


def test_coder_is_smaller_than_general_compression():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    ids = np.concatenate(list(token_files.LibraryTokenizer(JSON, P.PATTERN).encode(texts)))
    blocks = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
    codes = idcoder.encode_blocks(blocks)
    assert sum(map(len, codes)) < 0.9 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    assert 8 * sum(map(len, codes)) / len(ids) < 9
    assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(codes, [len(b) for b in blocks]), blocks))


def test_long_block_is_coded_side_by_side(monkeypatch):
    """The steps of a long block are a small share of its ids; before, a block took a step for each of them."""
    steps, predict = [], idcoder._Model.predict
    monkeypatch.setattr(idcoder._Model, "predict", lambda self, n: (steps.append(n), predict(self, n))[1])
    rng = np.random.default_rng(5)
    block = rng.zipf(1.3, 60_000) % 50_000
    block[20_000:30_000] = 7  # long runs that ids never seen before break
    block[20_000:30_000:997] = 65_535 - np.arange(11)
    code = idcoder.encode_blocks([block])
    assert len(steps) <= 600 and sum(steps) == len(block)
    assert (idcoder.decode_blocks(code, [len(block)])[0] == block).all()
    assert len(code[0]) < len(zlib.compress(block.astype("<u2").tobytes(), 9))
    for wrong in (code[0][:-2], code[0] + b"ab"):
        with pytest.raises(ValueError):
            idcoder.decode_blocks([wrong], [len(block)])


def test_logistic_tables():
    x = np.arange(-2048, 2048)
    assert (np.abs(idcoder._SQUASH - (4096 / (1 + np.exp(-x / 256)))) <= 1).all()


def file_of(docs):
    out = io.BytesIO()
    w = token_files.IdFileWriter(out)
    for i, ids in docs:
        w.add(i, np.array(ids, np.int64))
    w.close()
    return out.getvalue()


def test_file_round_trip_and_damage(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng = np.random.default_rng(4)
    docs = [(None, [0]), (-5, [7, 0]), (3, rng.integers(0, 900, 700).tolist() + [0]), (3, [0]), (9, rng.integers(0, 50000, 333).tolist())]
    raw = file_of(docs)
    got = {}
    for k, (i, done, ids) in enumerate(token_files.read_id_file(io.BytesIO(raw))):
        got.setdefault(len([1 for x in got.values() if x[1]]), [i, False, []])
        at = got[max(got)]
        at[1], at[2] = done, at[2] + ids.tolist()
    assert [(i, ids) for i, _, ids in got.values()] == docs
    for at in (9, 40, len(raw) - 25, len(raw) - 3):
        broken = bytearray(raw)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            list(token_files.read_id_file(io.BytesIO(bytes(broken))))


def test_token_files(spark):
    library = Tokenizer.from_file(JSON)
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.token_file_round_trip(table(spark).repartition(4), JSON, P.PATTERN).collect()
    want = {}
    for r in data:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    mine, start = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        mine.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [r[0] for r in data]
    assert token_files.token_file_round_trip(empty(spark), JSON, P.PATTERN).count() == 0


def test_token_files_know_added_tokens(spark):
    library, mark = Tokenizer.from_file(JSON), "<|endoftext|>"
    texts = [f"one {mark} two", mark, f"{mark}{mark}", f"a  {mark}\n\n  b{mark}", f"{mark[:-1]} {mark}>", "plain", mark * 3 + "é", None]
    data = [(i, t, None, None) + (None,) * 14 for i, t in enumerate(texts)]
    got = token_files.token_file_round_trip(table(spark, data), JSON, P.PATTERN).collect()
    start = 0
    for (i, text, *_), r in zip(data, sorted(got, key=lambda r: r.start), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_are_encoded_as_in_their_text():
    """White space of all kinds, and added tokens beside it, as the library has them in the whole text."""
    library, mine = Tokenizer.from_file(JSON), token_files.LibraryTokenizer(JSON, P.PATTERN)
    rng, parts = random.Random(3), [" ", "\n", "\t", "\r", "\xa0", "\x1c", "\u3000", "\x85", "a", "é", "日", "1", "²", "'s", ".", "<|endoftext|>", "<|end", " the", "\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for at in range(0, len(texts), 400):
        for text, ids in zip(texts[at : at + 400], mine.encode(texts[at : at + 400]), strict=True):
            assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
    assert list(mine.encode([])) == []


def test_new_words_go_to_the_library_together(monkeypatch):
    class Counted:
        def __init__(self, inner):
            self.inner, self.given = inner, 0

        def encode_batch(self, texts, **how):
            self.given += len(texts)
            return self.inner.encode_batch(texts, **how)

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return self.inner.encode_batch_fast(texts, **how)

    mine = token_files.LibraryTokenizer(JSON, P.PATTERN)
    mine.tokenizer = Counted(mine.tokenizer)
    text = "first " + " ".join(f"w{i:x}é." for i in range(3000)) + "\nend"
    (ids,) = mine.encode([text])
    assert mine.tokenizer.given < 100
    assert ids.tolist() == [*Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids, 0]
    monkeypatch.setattr(token_files, "MEMO", 10)
    assert [x.tolist() for x in mine.encode([text, text])] == [ids.tolist()] * 2  # after the memo was dropped


def test_texts_without_spaces_are_cut_by_the_pattern():
    library, mine = Tokenizer.from_file(JSON), token_files.LibraryTokenizer(JSON, P.PATTERN)
    texts = ["字，" * 3000, "a  b\t\tc  " * 400, "x " + "ab1." * 900 + " y\n" + "é-" * 700, "\r\n".join(["    q = 1"] * 200)]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert max(len(k[0] if isinstance(k, tuple) else k) for k in mine.known if k != token_files._END) <= token_files.LONG_WORD
    mine.n_chars = token_files.MEMO_CHARS + 1
    assert [len(x) for x in mine.encode(["one"])] == [2] and mine.n_chars == 3  # the memo was dropped


# --- archives ---


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, html string, digest string, row string")


def some_pages():
    rng = random.Random(6)
    body = lambda n: "".join(rng.choice("abc<p>é日\r\n0") for _ in range(n))
    data = [(i, f"http://x/{i}", body(rng.choice([0, 3, 200, 5000, 30000]))) for i in range(40)]
    data += [(100 + i, None, data[5][2]) for i in range(5)] + [(200, "a\r\nb: c", None), (201, "u", "")]
    return data + [data[7], (None, "n", "no id"), (None, "n", data[5][2]), (300, "z", "q" * 200_000)]


@pytest.mark.parametrize("least", [0, 100])
def test_archives(spark, tmp_path, least):
    data = some_pages()
    files = warc.write_archives(pages(spark, data).repartition(3), f"{tmp_path}/a", min_revisit_bytes=least)
    got = warc.read_archives(spark, files).collect()
    assert len(got) == len(data) and all(r.problem is None for r in got)
    groups = {}
    for i, _, html in data:
        groups.setdefault((html or "").encode(), []).append(i)
    want = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        known = [i for i in ids if i is not None]
        keep, rest = (max(known) if known else None), list(ids)
        rest.remove(keep)
        if len(payload) < least:
            want += [(str(i), len(payload), digest, "response", "None") for i in ids]
        else:
            want += [(str(keep), len(payload), digest, "response", "None")] + [(str(i), len(payload), digest, "revisit", str(keep)) for i in rest]
    mine = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got]
    assert sorted(mine) == sorted(want)
    by_digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in groups}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in got if r.record_type == "response")
    assert max(r.n_segments for r in got) > 20


def test_archives_empty(spark, tmp_path):
    assert warc.archive_round_trip(pages(spark, []), f"{tmp_path}/a").count() == 0


def test_reassembly_reports_what_is_wrong():
    part = lambda n, b: {"segment": n, "block": b}
    assert warc.reassemble([part(2, b"cd"), part(1, b"ab")], 4) == (b"abcd", None)
    assert warc.reassemble([part(1, b"ab"), part(3, b"cd")], 4)[1]
    assert warc.reassemble([part(1, b"ab"), part(1, b"cd")], 4)[1]
    assert warc.reassemble([part(1, b"ab"), part(2, b"cd")], 5)[1]
    assert warc.reassemble([part(1, b"ab"), part(2, b"cd")], None)[1]


def test_chunked_framing():
    for payload in (b"", b"a", b"x" * 10_000, bytes(range(256)) * 40):
        assert warc.from_chunks(warc.to_chunks(payload)) == payload
    assert warc.from_chunks(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.from_chunks(broken)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"


def test_plain_archives_are_read_too():
    import gzip

    raw = b"".join(gzip.decompress(warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b"x" * i * 50_000)) for i in range(4))
    got = list(warc.read_records(io.BytesIO(raw)))
    assert [len(b) for _, b, _ in got] == [0, 50_000, 100_000, 150_000] and got[2][0]["warc-record-id"] == "<2>"


def damaged(kind):
    """An archive of ten records with the sixth damaged."""
    fields = lambda i: {"WARC-Type": "resource" if i == 2 else "response", "WARC-Record-ID": f"<{i}>", "WARC-Target-URI": f"u{i}"}
    noise = lambda i: random.Random(i).randbytes(3000).replace(b"\n", b"x")
    made = [warc.record(fields(i), (b"" if i == 2 else b"HTTP/1.1 200 OK\r\n\r\n") + noise(i)) for i in range(10)]
    if kind == "member":
        made[5] = made[5][:1500] + b"\0" * 40 + made[5][1540:]
    elif kind == "cut member":
        made = made[:5] + [made[5][:1500]]
    elif kind == "no length":
        made[5] = gzip.compress(gzip.decompress(made[5]).replace(b"Content-Length: 3019\r\n", b""))
    elif kind == "cut plain":
        made = [gzip.decompress(m) for m in made[:6]]
        made[5] = made[5][:1000]
    elif kind == "no record":
        made[5] = gzip.compress(b"something else\r\n" * 9)
    return b"".join(made)


@pytest.mark.parametrize("kind", ["member", "cut member", "no length", "cut plain", "no record"])
def test_damaged_archives_give_problem_rows(spark, tmp_path, kind):
    (tmp_path / "x.warc.gz").write_bytes(damaged(kind))
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "uri string")
    got = warc.read_archives(spark, files).collect()
    good = {r.url: r for r in got if r.problem is None}
    assert set(good) == {f"u{i}" for i in range(5 if kind.startswith("cut") else 10) if i != 5}
    assert all(r.payload_bytes == 3000 for r in good.values()) and good["u2"].record_type == "resource"
    bad = [r for r in got if r.problem is not None]
    assert len(bad) == 1 and bad[0].url in ("u5", None) and bad[0].payload is None


def test_damaged_segment_is_a_problem(spark, tmp_path):
    files = warc.write_archives(pages(spark, [(1, "u", "y" * 30_000), (2, "v", "short")]).coalesce(1), f"{tmp_path}/a")
    path = files.first().uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    members = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", bytes(raw))]
    third = members[3]
    raw[third + 60] ^= 0x55
    open(path, "wb").write(raw)
    got = {r.url: r.problem for r in warc.read_archives(spark, files).collect() if r.url}
    assert got["v"] is None and got["u"] is not None
