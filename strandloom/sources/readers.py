"""FASTQ, FASTA and BAM files, and tables, as frames (read_no, name, seq, qual).

FASTQ text is read by Spark's text source, which splits large files anywhere.
A first pass counts the lines of each split and keeps its first three; then
each split knows which line of a record it starts with, and completes its last
record with what the next split begins with.  So a file of any size is read in
parallel, in order, and nothing is shuffled.  BAM files are read in the same
way, by their blocks.
"""

from __future__ import annotations

import atexit
import gzip
import io
import struct
import tempfile
import uuid
import zlib
from collections import deque
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.model import ConfigError, Reads

SCHEMA = "read_no long, name string, seq string, qual string"


def found_files(spark: SparkSession, path: str) -> list:
    """The files, as Hadoop's Paths, that a path, a folder or a pattern names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], list(fs.globStatus(at) or ())
    for status in todo:
        if status.isDirectory():
            todo += [x for x in fs.listStatus(status.getPath()) if x.getPath().getName()[0] not in "._"]
        else:
            out.append(status.getPath())
    if not out:
        raise FileNotFoundError(path)
    return out


def first_bytes(spark: SparkSession, path: str, count: int = 65_536) -> bytes:
    """A file's first bytes, and no more of it, through Hadoop's file system."""
    file = found_files(spark, path)[0]
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readNBytes(count))
    finally:
        stream.close()


def with_suffix(spark: SparkSession, path: str) -> str:
    """The path of compressed text under a name by which Spark's text source knows its codec; a copy if its own name doesn't tell."""
    suffix = {b"\x1f\x8b": ".gz", b"\x28\xb5": ".zst"}.get(first_bytes(spark, path, 2))
    if suffix is None or path.endswith(suffix):
        return path
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandloom-")
    (file,) = found_files(spark, path)
    to = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(file.getFileSystem(conf), file, to.getFileSystem(conf), to, False, conf)
    atexit.register(removed, spark, to)
    return to.toString()


def removed(spark: SparkSession, path) -> None:
    try:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def sniffed(spark: SparkSession, path: str) -> str:
    """The format of a file by its first bytes: fastq, fasta or bam; compressed ones are looked into."""
    head = first_bytes(spark, path)
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 64)
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        head = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(head)).read(64)
    if head[:4] == b"BAM\1":
        return "bam"
    return "fasta" if head[:1] == b">" else "fastq"


def record(lines: list[str], place: str) -> tuple[str, str, str]:
    """(name, seq, qual) of four lines; what is wrong is an error."""
    head, seq, plus, qual = lines
    if not head.startswith("@"):
        raise ValueError(f"{place}: a record doesn't start with @: {head[:50]!r}")
    if len(head) == 1:
        raise ValueError(f"{place}: a record has no name")
    if not plus.startswith("+"):
        raise ValueError(f"{place}: a record's third line doesn't start with +: {plus[:50]!r}")
    if len(seq) != len(qual):
        raise ValueError(f"{place}: {head[1:50]!r} has {len(seq)} bases and {len(qual)} qualities")
    return head[1:], seq, qual


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of files one after another; paths that Spark's text source reads (plain or gzip)."""
    frames, base = [], 0
    for path in paths:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("start"))

        def heads(batches):
            first, count, last = {}, {}, {}
            for batch in batches:
                starts, values = batch.column(1).to_pylist(), batch.column(0)
                for s in dict.fromkeys(starts):
                    own = [k for k, x in enumerate(starts) if x == s]
                    count[s] = count.get(s, 0) + len(own)
                    last[s] = values[own[-1]].as_py()
                    if len(first.setdefault(s, [])) < 3:
                        first[s] += [values[k].as_py() for k in own[: 3 - len(first[s])]]
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64()), pa.array(first.values(), pa.list_(pa.string())), pa.array(last.values(), pa.string())], ["start", "n", "first", "last"])

        splits = sorted(lines.mapInArrow(heads, "start long, n long, first array<string>, last string").collect())  # a row for each split
        total = sum(r["n"] for r in splits)
        blank = bool(splits) and total % 4 == 1 and splits[-1]["last"] == ""  # an empty line at the end
        if total % 4 and not blank:
            raise ValueError(f"{path}: the last record is not complete")
        at, offset, after = 0, {}, {}
        for k, r in enumerate(splits):
            offset[r["start"]] = at
            after[r["start"]] = [x for later in splits[k + 1 : k + 5] for x in later["first"]][:3]
            at += r["n"]

        def records(batches, offset=offset, after=after, base=base, path=path):
            current, held, at = None, [], 0

            def rows(final: bool):
                nonlocal held, at
                if final:
                    missing = -(at + len(held)) % 4
                    held += after[current][:missing] if missing and len(after[current]) >= missing else []
                n = len(held) // 4
                out = [(base + (at + 4 * k) // 4, *record(held[4 * k : 4 * k + 4], path)) for k in range(n)]
                held, at = held[4 * n :], at + 4 * n
                return pd.DataFrame(out, columns=["read_no", "name", "seq", "qual"])

            for batch in batches:
                starts, values = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for s in dict.fromkeys(starts):
                    own = values if starts[0] == starts[-1] == s else [v for v, x in zip(values, starts, strict=True) if x == s]
                    if s != current:
                        if current is not None:
                            yield pa.RecordBatch.from_pandas(rows(True), schema=ARROW, preserve_index=False)
                        current, held = s, []
                        skip = -offset[s] % 4
                        at = offset[s] + skip
                        own, left = own[skip:], max(0, skip - len(own))
                    elif left:
                        own, left = own[left:], max(0, left - len(own))
                    held += own
                    yield pa.RecordBatch.from_pandas(rows(False), schema=ARROW, preserve_index=False)
            if current is not None:
                yield pa.RecordBatch.from_pandas(rows(True), schema=ARROW, preserve_index=False)

        frames.append(lines.mapInArrow(records, SCHEMA))
        base += total // 4
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


ARROW = pa.schema([("read_no", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


def numbered(frames: list[DataFrame]) -> DataFrame:
    """Frames (path order: part, place; name, seq, qual) as one with a running read_no.

    Rows per part are counted in a first pass, so that numbers run without one task for all.
    """
    out, base = None, 0
    for df in frames:
        counts = sorted(df.groupBy("part").count().collect())
        starts, at = [], base
        for r in counts:
            starts.append((r["part"], at))
            at += r["count"]
        base = at
        known = df.sparkSession.createDataFrame(starts, "part long, _base long")
        from pyspark.sql import Window

        inside = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
        rows = df.withColumn("_in", inside).join(F.broadcast(known), "part").select((F.col("_base") + F.col("_in")).alias("read_no"), "name", "seq", "qual")
        out = rows if out is None else out.unionAll(rows)
    return out


def read_fasta(spark: SparkSession, paths: list[str], fake_quality: str | int) -> DataFrame:
    """Records of FASTA files; sequences may span lines; qualities are one letter (or byte) repeated."""
    fake_quality = chr(fake_quality) if isinstance(fake_quality, int) else fake_quality
    if len(fake_quality) != 1:
        raise ConfigError("a FASTA file needs fasta_fake_quality, one letter")
    frames = []
    for path in paths:
        raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "\r", "").alias("value"))
        clean = raw.withColumn("value", F.regexp_replace("value", r"\A>", "")).where(F.length(F.trim("value")) > 0)
        name, rest = F.substring_index("value", "\n", 1), F.regexp_extract("value", r"(?s)\A[^\n]*\n(.*)", 1)
        parsed = clean.select("part", "place", name.alias("name"), F.regexp_replace(rest, r"\s", "").alias("seq"))
        frames.append(parsed.withColumn("qual", F.repeat(F.lit(fake_quality), F.length("seq"))))
    return numbered(frames)


#: The letters of a BAM record's 4-bit bases, by hexadecimal digit; qualities as letters; what follows the first 12 bytes of each block of a BAM file.
BAM_BASES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
BAM_QUALITIES = bytes(min(q, 93) + 33 for q in range(256))
BAM_MARK = b"BC\2\0"


def bam_start(raw: bytes) -> int | None:
    """Where a BAM file's first record starts; None if its header is longer than the given bytes."""
    if raw[:4] != b"BAM\1"[: len(raw)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        references = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(references):
            at += 8 + struct.unpack_from("<i", raw, at)[0]
    except struct.error:
        return None
    return at if at <= len(raw) else None


def bam_record(raw: bytes, at: int) -> tuple[bool, str, str, str]:
    """(is mapped, name, seq, qual) of the record at a place."""
    reference, name_size, ops, bases = struct.unpack_from("<i4xB3xH2xi", raw, at + 4)
    p = at + 36
    name = raw[p : p + name_size - 1].decode("latin-1")
    p += name_size + 4 * ops
    end = p + (bases + 1) // 2
    return reference >= 0, name, raw[p:end].hex().translate(BAM_BASES)[:bases], raw[end : end + bases].translate(BAM_QUALITIES).decode()


def bam_records(data: bytes):
    """(is mapped, name, seq, qual) of a BAM file's bytes."""
    raw = gzip.decompress(data)
    at = bam_start(raw)
    if at is None:
        raise ValueError("a BAM file's header is not complete")
    while at < len(raw):
        size = bam_size(raw, at)
        if size is None or at + size > len(raw):
            raise ValueError("a BAM file's last record is not complete")
        yield bam_record(raw, at)
        at += size


def bam_size(raw: bytes, at: int) -> int | None:
    """The bytes of the record at a place, with those of its size, if the size is there."""
    return 4 + struct.unpack_from("<i", raw, at)[0] if at + 4 <= len(raw) else None


def bam_guess(raw: bytes, records: int = 64) -> int | None:
    """The first place from which `records` records follow one another, else that with most; whether it is right shows when splits are put together."""
    best, most = None, 0
    for first in range(len(raw) - 36):
        at, found = first, 0
        while found < records and at + 36 <= len(raw):
            size, reference, name_size, ops, bases = struct.unpack_from("<iixxxxB3xH2xi", raw, at)
            if name_size < 1 or reference < -1 or bases < 0 or size < 32 + name_size + 4 * ops + (bases + 1) // 2 + bases:
                break
            if at + 36 + name_size <= len(raw) and raw[at + 35 + name_size]:
                break
            at, found = at + 4 + size, found + 1
        else:
            if found == records:
                return first
            if found > most:
                best, most = first, found
    return best


def bam_blocks(pieces):
    """The contents of blocks from what lies between the marks of a split; one that isn't whole is an error.

    A piece is a block's size, data, sum and length, then the 12 bytes before
    the next mark.  A mark that data contain by chance gives a short piece.
    """
    held = None
    for piece in pieces:
        held = piece if held is None else held + BAM_MARK + piece
        size = struct.unpack_from("<H", held)[0] - 15 if len(held) >= 2 else len(held) + 1
        if len(held) < size:
            continue
        if len(held) not in (size, size + 12):
            raise ValueError("a BAM file's block has another length than it says")
        data = zlib.decompress(held[2 : size - 8], -15)
        if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", held, size - 8):
            raise ValueError("a BAM file's block is damaged")
        held = None
        yield data
    if held is not None:
        raise ValueError("a BAM file's last block is not complete")


def bam_splits(batches):
    """(start, pieces) of each split among rows (piece, start); the pieces must be read before the next split."""
    rows = ((s, piece) for batch in batches for s, piece in zip(batch.column(1).to_pylist(), batch.column(0), strict=True))
    for start, own in groupby(rows, itemgetter(0)):
        pieces = (piece.as_py() for _, piece in own)
        if start == 0:
            next(pieces)  # what stands before the first mark
        yield start, pieces


def bam_layout(lines: DataFrame) -> list[dict] | None:
    """Of each split of a BAM file in order: its start, records (mapped, others) that start in it, bytes before the first and of the last, if that goes on behind it.

    Where a split's first record starts is guessed, and so proved: the first
    split is known, and the last record of each must end where the next one's
    first starts.  None if it doesn't, or if blocks lie across splits unseen.
    """

    def run(batches):
        for start, pieces in bam_splits(batches):
            raw, at, head, count, good = b"", None, b"", [0, 0], True
            try:
                for data in chain(bam_blocks(pieces), [b""]):
                    raw += data
                    if at is None:
                        if start and data and len(raw) < 1 << 18:
                            continue
                        at = bam_guess(raw) if start else bam_start(raw)
                        if at is None:
                            continue
                        head = raw[:at] if start else b""
                    while (size := bam_size(raw, at)) is not None and at + size <= len(raw):
                        count[struct.unpack_from("<i", raw, at + 4)[0] < 0] += 1
                        at += size
                    raw, at = raw[at:], 0
                good = at == 0 or not raw
            except (ValueError, zlib.error, struct.error):
                good = False
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (start, *count, head, raw if good else b"", good)], ["start", "mapped", "others", "head", "tail", "good"])

    splits = sorted((r.asDict() for r in lines.mapInArrow(run, "start long, mapped long, others long, head binary, tail binary, good boolean").collect()), key=itemgetter("start"))
    splits = [r for k, r in enumerate(splits) if not k or r["mapped"] or r["others"] or r["head"] or r["tail"] or not r["good"]]
    if not splits or splits[0]["start"] or not all(r["good"] for r in splits):
        return None
    for r, later in zip(splits, [*splits[1:], None], strict=True):
        over = bytes(r["tail"]) + (bytes(later["head"]) if later else b"")
        if over:
            if bam_size(over, 0) != len(over):
                return None
            r["mapped" if struct.unpack_from("<i", over, 4)[0] >= 0 else "others"] += 1
        r["after"] = over[len(r["tail"]) :]
    return splits


BAM_ROWS = 10_000


def read_bam(spark: SparkSession, paths: list[str], include_mapped: bool, include_unmapped: bool) -> DataFrame:
    """Records of BAM files, in parallel and in order.

    A file is split anywhere by Spark's text source, whose lines end at the mark
    in each block's header.  Files that aren't made of such blocks are read
    whole by a task each.
    """
    if not (include_mapped or include_unmapped):
        raise ConfigError("include_mapped or include_unmapped must be true")
    wanted = (include_unmapped, include_mapped)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    def whole(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = [(0, k, n, s, q) for k, (mapped, n, s, q) in enumerate(bam_records(data.as_py())) if wanted[mapped]]
                for k in range(0, len(rows), BAM_ROWS):
                    columns = list(zip(*rows[k : k + BAM_ROWS], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "place", "name", "seq", "qual"])

    out, base = None, 0
    for path in (f.toString() for p in paths for f in found_files(spark, p)):
        blocked = first_bytes(spark, path, 16)[10:] == b"\6\0" + BAM_MARK and not path.endswith((".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4"))
        lines = spark.read.option("lineSep", BAM_MARK.decode()).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_block_start").alias("start"))
        splits = bam_layout(lines) if blocked else None
        if splits is None:
            found = numbered([spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, "part long, place long, name string, seq string, qual string")])
            rows, n = found.select((F.col("read_no") + base).alias("read_no"), "name", "seq", "qual"), found.count()
        else:
            first, n = {}, 0
            for r in splits:
                first[r["start"]] = (base + n, len(r["head"]), bytes(r["after"]))
                n += r["mapped"] * include_mapped + r["others"] * include_unmapped

            def records(batches, first=first):
                for start, pieces in bam_splits(batches):
                    if start not in first:
                        deque(pieces, 0)
                        continue
                    number, at, after = first[start]
                    raw, rows = b"", []
                    if not start:
                        at = None
                    for data in chain(bam_blocks(pieces), [after]):
                        raw += data
                        if at is None and (at := bam_start(raw)) is None or at > len(raw):
                            continue
                        while (size := bam_size(raw, at)) is not None and at + size <= len(raw):
                            mapped, *row = bam_record(raw, at)
                            at += size
                            if wanted[mapped]:
                                rows.append((number, *row))
                                number += 1
                        raw, at = raw[at:], 0
                        if len(rows) >= BAM_ROWS:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

            rows = lines.mapInArrow(records, SCHEMA)
        out, base = rows if out is None else out.unionAll(rows), base + n
    return out


def read_file(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """Files of one segment, by their format."""
    kinds = {sniffed(spark, p) for p in paths}
    if len(kinds) > 1:
        raise ConfigError(f"files of one segment have different formats: {sorted(kinds)}")
    kind = kinds.pop()
    if kind == "fasta":
        return read_fasta(spark, [with_suffix(spark, p) for p in paths], options.get("fasta_fake_quality", ""))
    if kind == "bam":
        if "bam_include_mapped" not in options or "bam_include_unmapped" not in options:
            raise ConfigError("a BAM file needs bam_include_mapped and bam_include_unmapped")
        return read_bam(spark, paths, options["bam_include_mapped"], options["bam_include_unmapped"])
    return read_fastq(spark, [with_suffix(spark, p) for p in paths])


def one_segment(df: DataFrame, segment: str = "read1") -> Reads:
    """A frame (read_no, name, seq, qual) as reads of one segment."""
    return Reads(df.select("read_no", F.struct("name", "seq", "qual").alias(segment)), (segment,))


def zipped(frames: dict[str, DataFrame], check: bool = True) -> Reads:
    """Segments by position: the i-th read of each; unequal counts are an error."""
    names = tuple(sorted(frames))
    if check and len({frames[s].count() for s in names}) > 1:
        raise ValueError("segments have different numbers of reads")
    out = None
    for s in names:
        df = frames[s].select("read_no", F.struct("name", "seq", "qual").alias(s))
        out = df if out is None else out.join(df, "read_no")
    return Reads(out, names)


def interleaved(df: DataFrame, segments: list[str]) -> Reads:
    """One stream whose record i belongs to segment i modulo their number; a last molecule that lacks records is an error."""
    k = len(segments)
    one = F.struct("name", "seq", "qual")
    grouped = df.groupBy(F.floor(F.col("read_no") / k).alias("read_no")).agg(*(F.max(F.when(F.col("read_no") % k == i, one)).alias(s) for i, s in enumerate(segments)))
    last = F.when(F.col(f"`{segments[-1]}`").isNull(), F.raise_error(F.lit("the last molecule is not complete"))).otherwise(F.col(f"`{segments[-1]}`"))
    return Reads(grouped.withColumn(segments[-1], last.cast(grouped.schema[segments[-1]].dataType)), tuple(segments))
