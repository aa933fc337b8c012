"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Each row becomes one record in a gzip member of its own.  Of rows with equal
payloads of at least `least` bytes, that with the smallest id is the response
and the others are revisits of it, without the payload.  Digests are SHA-1 in
base32 over the full payload.  The first of a digest is found by an aggregation
of digests and ids alone, combined before the shuffle; then rows are joined
with it, and a digest that very many rows share is split by the join's skew
handling.

Archives are written by Spark's text writer as raw bytes, one file per chunk of
about `chunk_bytes`, so that any file system Spark knows can hold them; the
line's end after each file is an empty gzip member.

The reader walks through members and their records.  A member that doesn't
decompress, or a record whose version line, headers, length, block digest or
end are wrong, fails; then the next place where a member starts (or, in plain
text, the next version line) is searched for and reading goes on there.  The
bytes between are quarantined: a row says from where to where, and why.  So
damage costs the records it touches only.

Null payloads are empty ones; null URIs become an empty target.  Rows with a
null id are archived and come after all others in the choice of the response.
Of rows that repeat id and payload, one is the response.  Empty tables give no
records.  Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import settled, split_batches

#: An empty gzip member, as it stands after each file's last record.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: The date of all records: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: an HTTP response with the payload, or its headers alone for a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{record_id}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: f"%{ord(m[0]):02X}", uri), f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if kind == "revisit":
        headers += [f"WARC-Refers-To: <urn:row:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    headers += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, path: str, least: int = 0, chunk_bytes: int = 16 << 20, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row under path.

    Rows that repeat an id are told apart by their places, so rows that come out of a shuffle are stored before.
    """
    rows = settled(rows.select(id_col, uri_col, payload_col), "archive-rows")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    full = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row")).alias("me"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    first = full.where(F.col("size") >= least).groupBy("digest").agg(F.min(F.struct("me.none", "me.id", "me.row")).alias("first"))
    marked = full.join(first.hint("shuffle_hash"), "digest", "left").select("me", "first", "uri", "payload")

    def run(batches):
        held, size = [], 0
        name = lambda x: f"{'' if x['none'] else x['id']}:{x['row']}"
        for batch in split_batches(batches, "payload"):
            for me, first, uri, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = first is not None and first != me
                held.append(gzip.compress(record("revisit" if again else "response", name(me), uri, data, name(first) if again else None), 5, mtime=0))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    chunks = marked.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    chunks.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of plain bytes and where it ends; ValueError says what is wrong."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers without end")
    headers = {}
    for x in data[line.end() : end].split(b"\r\n"):
        key, colon, value = x.partition(b":")
        if not colon:
            raise ValueError("a header without colon")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start, size = end + 4, int(headers["content-length"])
    block = data[start : start + size]
    if len(block) != size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("wrong block digest")
    inner, _, body = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", inner)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers.get("warc-type") == "revisit"
    if not revisit and digest and digest != sha1_base32(body):
        raise ValueError("wrong payload digest")
    return {"headers": headers, "payload": None if revisit else body, "size": int(length[1]) if length else len(body), "digest": digest or sha1_base32(body)}, start + size + 4


def plain_records(data: bytes, offset: int, plain: bool):
    """(record, None) and (None, gap) of plain bytes; places are in the file: those of data plus offset, or a member's start."""
    at = 0
    while at < len(data):
        try:
            found, end = parse_record(data, at)
        except ValueError as e:
            after = VERSION_LINE.search(data, at + 1)
            end = after.start() if after else len(data)
            yield None, (offset + at * plain, offset + end * plain, str(e))
        else:
            yield found, None
        at = end


def unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What the member at a place holds, and where it ends."""
    unzip, view, parts = zlib.decompressobj(31), memoryview(data), []
    while not unzip.eof:
        if at >= len(data):
            raise ValueError("a member without end")
        parts.append(unzip.decompress(view[at : at + 65536]))
        at += 65536
    return b"".join(parts), min(at, len(data)) - len(unzip.unused_data)


def salvage(data: bytes):
    """(record, None) for each record of an archive's bytes, and (None, (start, end, why)) for each gap."""
    at = 0
    while at < len(data):
        if data.startswith(MEMBER, at):
            try:
                plain, end = unpacked(data, at)
            except (zlib.error, ValueError) as e:
                end = next_start(data, at + 1)
                yield None, (at, end, f"member: {e}")
            else:
                for found, gap in plain_records(plain, at, False):
                    yield found, gap and (at, end, gap[2])
            at = end
            continue
        if VERSION_LINE.match(data, at):
            try:
                found, end = parse_record(data, at)
                yield found, None
            except ValueError as e:
                end = next_start(data, at + 1)
                yield None, (at, end, str(e))
        else:
            end = next_start(data, at + 1)
            if data[at:end].strip(b"\r\n"):
                yield None, (at, end, "neither a member nor a version line")
        at = end


def next_start(data: bytes, at: int) -> int:
    """The next place where a member that decompresses, or a version line, starts."""
    while at < len(data):
        member = data.find(MEMBER, at)
        line = VERSION_LINE.search(data, at)
        places = [x for x in (member, line.start() if line else -1) if x >= 0]
        if not places:
            return len(data)
        at = min(places)
        if line and at == line.start():
            return at
        try:
            first = zlib.decompressobj(31).decompress(data[at : at + 65536], 16)
            if not first or VERSION_LINE.match(first):
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Per record: file, id (null if it had none), payload_bytes and payload_digest of the full payload, record_type, refers_to, target_uri, payload (null for revisits); per gap: file, gap_start, gap_end, gap_reason."""
    text = [("file", pa.string()), ("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string()), ("payload", pa.binary())]
    text = text if with_payload else text[:-1]

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:row:(-?\d+):\d+>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for found, gap in salvage(data.as_py()):
                    if gap:
                        rows.append((file, None, None, None, None, None, None, *gap, None))
                    else:
                        h = found["headers"]
                        rows.append((file, number(h.get("warc-record-id")), found["size"], found["digest"], h.get("warc-type"), number(h.get("warc-refers-to")), h.get("warc-target-uri"), None, None, None, found["payload"]))
                        size += len(found["payload"] or b"") * with_payload
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), text, strict=False)], [n for n, _ in text])

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in text))
