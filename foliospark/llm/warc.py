"""WARC archives: write pages with segmentation and revisits, read them back with reassembly.

Writing.  A page's payload goes into a ``response`` record behind a HTTP head, in chunked transfer framing.  A block over
``segment_bytes`` is cut: the first part is the response itself, with segment number 1; the others are ``continuation``
records that name it as origin, and the last also gives the total length.  Of pages with equal payloads, that with the
largest id is stored; the others become ``revisit`` records that refer to it.  Every record is a gzip member of its own.
Each task writes one file and reports its name; a lost attempt's file is never read.

Reading.  Tasks parse whole files record by record.  Records are grouped by origin, continuation records are put in order of
their segment number, the numbers must be 1 to n and the joined block must have the stated total length; then the
chunked framing is undone and the payload's digest compared.  What fails is returned with its ``problem``, never dropped:
a damaged gzip member, a header without a usable length or a record cut short gives a row with what is known of it, and
reading goes on at the next record that can be found.  Resource and conversion records are returned with their block as
payload; warcinfo, request and metadata records are not pages and are passed over.  Ids come from a header that only this
writer sets; pages of other archives have null ids and are told apart by URL.  A group is the segments of one record, so
nothing larger than one payload is gathered.

A null payload is the empty one, a null URL or id is left out and read as null.  Which page of a frequent payload stays
is settled by heavy-hitter winners (see ``exact_dedup``), so equal payloads never meet in one task in masses.
Repeated rows (same id and payload) give one response and revisits of it.  Other input columns are not read.  An empty
table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, fresh_path
from .common import text_or_empty
from .exact_dedup import frequent_winners, place_in_group, with_winners
from .files import new_file, open_file

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"  # a gzip member begins so
HTTP_TYPE = "application/http; msgtype=response"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- one record ---


def to_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped.  ValueError if it is broken."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0].strip(), 16)
        at = stop + 2
        if size < 0 or at + size > len(body):
            raise ValueError("chunk beyond the end")
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of a stored HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return from_chunks(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head + b"\r") else body


def record(fields: dict, block: bytes) -> bytes:
    """One gzip member.  Fields that are None are left out; line ends in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def page_records(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; ``name`` makes its record id unique."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    key = f"<urn:page:{page_id}:{digest}:{name}>"
    fields = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": key, "WARC-Date": DATE, "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": HTTP_TYPE, "X-Page-Id": page_id, "X-Payload-Length": len(payload),
    }
    if is_revisit:
        refers = f"<urn:page:{refers_to}:{digest}:0>"
        yield record(fields | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers, "X-Refers-To-Page-Id": refers_to}, head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record(fields | {"WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = {
            "WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{page_id}:{digest}:{name}:{n}>", "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": key, "WARC-Segment-Number": n,
            "WARC-Segment-Total-Length": len(block) if n == len(parts) else None,
        }
        yield record(more, part)


class _Members:
    """Reads the members of a gzip file one after another; a damaged one raises ``zlib.error`` or ``EOFError``."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, b"", 0
        self._open()

    def _open(self) -> None:
        self.member, self.start = zlib.decompressobj(31), self.at

    def read(self, size: int) -> bytes:
        while True:
            if self.member.eof:
                self.raw = self.member.unused_data
                self._open()
            self.raw = self.raw or self.stream.read(1 << 16)
            if not self.raw:
                if self.at > self.start:
                    raise EOFError("member cut short")
                return b""
            taken, self.raw = self.raw, b""
            out = self.member.decompress(taken)
            self.at += len(taken) - len(self.member.unused_data)
            if out:
                return out

    def skip(self) -> None:
        """Go on at the next place behind the start of this member that looks like a member."""
        at = self.start + 1
        self.stream.seek(at)
        held = b""
        while more := self.stream.read(1 << 16):
            held += more
            if (found := held.find(MEMBER)) >= 0:
                at += found
                break
            at, held = at + max(0, len(held) - 2), held[-2:]
        else:
            at = self.stream.seek(0, 2)
        self.stream.seek(at)
        self.raw, self.at = b"", at
        self._open()


def read_records(stream) -> Iterator[tuple[dict, bytes, str | None]]:
    """(fields in lower case, block, problem) of a plain or gzipped archive, one at a time.  After a problem reading goes on
    at the next line that begins a record."""
    start = stream.read(2)
    stream.seek(0)
    source = _Members(stream) if start == MEMBER[:2] else stream
    pending = b""
    lost = False  # between a problem and the next record

    def line() -> bytes:
        nonlocal pending
        parts, stop = [], pending.find(b"\n")
        while stop < 0:
            parts.append(pending)
            pending = b""
            if not (pending := source.read(1 << 16)):
                return b"".join(parts)
            stop = pending.find(b"\n")
        out, pending = pending[: stop + 1], pending[stop + 1 :]
        return b"".join((*parts, out))

    while True:
        fields, block = {}, b""
        try:
            first = line()
            if not first:
                return
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                if not lost:
                    lost = True
                    yield fields, block, "not a WARC record"
                continue
            lost = False
            while (x := line()).strip():
                k, _, v = x.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            stated = fields.get("content-length", "")
            if not (stated.isascii() and stated.isdigit()):
                lost = True
                yield fields, block, "no usable length"
                continue
            size = int(stated)
            parts, have = [pending], len(pending)
            pending = b""
            while have < size and (more := source.read(min(max(1 << 16, size - have), 1 << 24))):
                parts.append(more)
                have += len(more)
            joined = b"".join(parts)
            block, pending = joined[:size], joined[size:]
        except (zlib.error, EOFError) as e:
            pending = b""
            if not lost:
                lost = True
                yield fields, block, f"damaged compression: {e}"
            source.skip()
            continue
        yield fields, block, None if len(block) == size else "record cut short"


# --- whole tables ---


def _with_response(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``refers_to`` and ``is_revisit`` to (page_id, url, payload) rows."""
    digest = F.when(F.length("payload") >= min_bytes, F.sha1("payload"))
    rows = pages.withColumn("digest", digest)
    keys = durable(rows.filter("digest is not null").select(F.col("page_id").alias("doc_id"), "digest"), "warc-digests")
    winners = durable(frequent_winners(keys), "warc-winners")
    alone = rows.filter("digest is null").select("page_id", "url", "payload", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), F.lit(False).alias("is_revisit"))
    named = with_winners(rows.filter("digest is not null").withColumnRenamed("page_id", "doc_id"), winners)
    settled = named.filter("lost").select(F.col("doc_id").alias("page_id"), "url", "payload", F.col("win_id").alias("refers_to"), F.lit(True).alias("is_revisit"))
    met = named.filter("not lost").withColumn("keep_id", F.max("doc_id").over(Window.partitionBy("digest"))).withColumn("place", place_in_group())
    again = F.col("place") > 1
    met = met.select(F.col("doc_id").alias("page_id"), "url", "payload", F.when(again, F.col("keep_id")).alias("refers_to"), again.alias("is_revisit"))
    return met.unionByName(settled).unionByName(alone) if min_bytes > 0 else met.unionByName(settled)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Write one archive per task under ``folder``; the table of the files: uri, bytes, records."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).cast("binary").alias("payload")
    )
    rows = _with_response(rows, min_revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, uri, size = 0, None, 0
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is not None:
            with new_file(folder, ".warc.gz") as (out, uri):
                size += out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{uri.rsplit('/', 1)[1]}>", "WARC-Date": DATE}, b""))
                for batch in (b for part in ([first], batches) for b in part):
                    for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "is_revisit"))):
                        page_id, url, payload, refers_to, again = row
                        # The one stored record of a digest is number 0; others are told apart by file and place.
                        stored = not again and len(payload) >= min_revisit_bytes
                        name = "0" if stored else f"{uri.rsplit('/', 1)[1][:32]}.{count}"
                        for r in page_records(page_id, url, payload, payload_digest(payload), refers_to, again, name, segment_bytes):
                            size += out.write(r)
                            count += 1
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [size], "records": [count]}, pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return durable(rows.mapInArrow(write, "uri string, bytes long, records long"), "warc-files")


_PAGE = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("n_segments", pa.int64()), ("problem", pa.string()),
])
_PAGE_SQL = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, "
    "n_segments long, problem string"
)
_READ = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), *_PAGE])
_READ_SQL = f"origin string, segment long, total long, block binary, {_PAGE_SQL}"


def _checked(block: bytes, stated: str | None) -> tuple:
    """payload, its length, digest and problem of a whole response block."""
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, None, stated, f"chunked framing: {e}"
    digest = payload_digest(payload)
    return payload, len(payload), digest, None if stated in (None, digest) else "digest differs"


def _number(fields: dict, name: str) -> int | None:
    """An integer field; None if it is missing or not one."""
    text = fields.get(name, "")
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}", text) else None


#: Kinds of records that are pages or parts of them, and those that say something about others.
PAGES, OTHERS = ("response", "revisit", "continuation", "resource", "conversion"), ("warcinfo", "request", "metadata")


def _row_of(fields: dict, block: bytes, problem: str | None, name: str, with_payload: bool) -> tuple | None:
    """A row of _READ.  Whole records are decoded at once; only segments keep their block.  ``name`` stands in for a record id."""
    kind = fields.get("warc-type")
    if kind in OTHERS and problem is None:
        return None
    if kind not in PAGES and problem is None:
        problem = f"unknown kind of record: {kind}"
    segment = _number(fields, "warc-segment-number")
    if problem is None and segment is None and "warc-segment-number" in fields:
        problem = "segment without a number"
    digest = fields.get("warc-payload-digest")
    digest = digest and digest.removeprefix("sha1:")
    payload, size = None, _number(fields, "x-payload-length")
    if problem is None and segment is None and kind == "response":
        payload, size, digest, problem = _checked(block, digest)
    elif problem is None and segment is None and kind in ("resource", "conversion"):
        found = payload_digest(block)
        payload, size, digest, problem = block, len(block), found, None if digest in (None, found) else "digest differs"
    if problem is not None:
        segment = segment and -segment  # a damaged segment leaves a gap
    return (
        fields.get("warc-segment-origin-id") or fields.get("warc-record-id") or name, segment, _number(fields, "warc-segment-total-length"),
        None if segment is None else block, _number(fields, "x-page-id"), fields.get("warc-target-uri"),
        None if kind == "continuation" else kind, _number(fields, "x-refers-to-page-id"), payload if with_payload else None,
        size, digest, 1, problem,
    )


def reassemble(parts: list[dict], total: int | None) -> tuple[bytes, str | None]:
    """The block made of segments, and what is wrong with it."""
    parts = sorted(parts, key=lambda p: p["segment"] or 0)
    numbers = [p["segment"] for p in parts]
    block = b"".join(p["block"] for p in parts)
    if numbers != list(range(1, len(parts) + 1)):
        return block, "segments missing or repeated"
    if total is None or total != len(block):
        return block, "total length differs"
    return block, None


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per page of the archives named in ``files.uri``: page_id, url, record_type, refers_to, payload (null for
    revisits), payload_bytes, payload_digest, n_segments, problem."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, size = [], 0
                with open_file(uri) as stream:
                    for n, (fields, block, problem) in enumerate(read_records(stream)):
                        if row := _row_of(fields, block, problem, f"{uri}#{n}", with_payload):
                            rows.append(row)
                            size += len(block) + 200
                        if size > 8 << 20 and rows:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = [r[n] for n in _PAGE.names]
                if any(p["segment"] is not None for p in r["parts"]):
                    block, problem = reassemble(r["parts"], r["total"])
                    payload, size, digest = None, r["payload_bytes"], r["payload_digest"]
                    if r["record_type"] is None:
                        problem = "no first segment"
                    elif problem is None and r["record_type"] == "response":
                        payload, size, digest, problem = _checked(block, digest)
                    elif problem is None:
                        payload, size = block, len(block)
                    row[4:] = payload if with_payload else None, size, digest, len(r["parts"]), problem
                out.append(row)
            columns = list(zip(*out)) or [()] * len(_PAGE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAGE.types)], schema=_PAGE)

    n = max(1, files.count())
    records = files.select("uri").repartition(n, "uri").mapInArrow(parse, _READ_SQL)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("total", *_PAGE.names)]
    whole = records.groupBy("origin").agg(F.collect_list(F.struct("segment", "block")).alias("parts"), *first)
    return whole.mapInArrow(finish, _PAGE_SQL)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    spark = pages.sparkSession
    files = write_archives(pages, folder or fresh_path(spark, "warc"))
    return read_archives(spark, files, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )
