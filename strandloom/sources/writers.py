"""Writers: reads as FASTQ, FASTA or BAM, one file in order or a folder of parts, raw or compressed, with hashes.

A named file is written by the driver from a stream of ordered partitions, of
which it holds one at a time; the blocks of a BAM file are made by the
executors.  For large results write_parts writes a folder of ordered parts from
the executors.
"""

from __future__ import annotations


import glob
import hashlib
import os
import struct
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.model import ConfigError

SUFFIXES = {"fastq": "fq", "fasta": "fasta", "bam": "bam"}
COMPRESSIONS = {"raw": "", "uncompressed": "", "gzip": "gz", "gz": "gz", "zstd": "zst", "zst": "zst"}


def file_name(prefix: str, parts: list[str], suffix: str, compression: str = "raw", separator: str = "_") -> str:
    """prefix, parts and suffix as a file's name; empty parts are left out."""
    extra = COMPRESSIONS[compression.lower()]
    return separator.join([prefix, *(p for p in parts if p)]) + f".{suffix}" + (f".{extra}" if extra and suffix != "bam" else "")


def record_text(kind: str) -> Column:
    """A record of columns name, seq, qual as text, without the last line's end."""
    if kind == "fasta":
        return F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq"))
    return F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))


def write_parts(df: DataFrame, path: str, kind: str = "fastq", compression: str = "gzip") -> None:
    """A folder of parts in the order of read_no."""
    ordered = df.repartitionByRange("read_no").sortWithinPartitions("read_no")
    ordered.select(record_text(kind).alias("value")).write.option("compression", {"raw": "none", "gz": "gzip", "zst": "zstd"}.get(compression, compression)).text(path)


class Output:
    """A file that is written as a stream, hashed before and after compression if asked."""

    def __init__(self, path: str, compression: str = "raw", level: int | None = None, hash_raw: bool = False, hash_compressed: bool = False):
        self.path = path
        self.inner = hashlib.sha256() if hash_raw else None
        self.outer = hashlib.sha256() if hash_compressed else None
        self.file = open(path, "wb")  # noqa: SIM115
        kind = COMPRESSIONS[compression.lower()]
        if kind == "gz":
            self.packer = zlib.compressobj(6 if level is None else level, zlib.DEFLATED, 31)
        elif kind == "zst":
            import zstandard

            self.packer = zstandard.ZstdCompressor(level=5 if level is None else level).compressobj()
        else:
            self.packer = None

    def write(self, data: bytes) -> None:
        if self.inner:
            self.inner.update(data)
        self._put(self.packer.compress(data) if self.packer else data)

    def _put(self, data: bytes) -> None:
        if self.outer:
            self.outer.update(data)
        self.file.write(data)

    def close(self) -> None:
        if self.packer:
            self._put(self.packer.flush())
        self.file.close()
        for digest, suffix in ((self.inner, "uncompressed"), (self.outer, "compressed")):
            if digest:
                with open(f"{self.path}.{suffix}.sha256", "w") as f:
                    f.write(digest.hexdigest())


#: Bits of a BAM record's flags.
UNMAPPED, PAIRED, MATE_UNMAPPED, FIRST, LAST = 4, 1, 8, 64, 128
#: Fixed value: the member that ends a BAM file.
BAM_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam_block(data: bytes) -> bytes:
    """Up to 64 KB as one member with its size in the header."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


#: A letter's 4-bit code as a hexadecimal digit; qualities without their offset.
BAM_DIGITS = bytes(b"0123456789abcdef"["=ACMGRSVTWYHKDBN".find(chr(c).upper()) % 16] for c in range(256))
BAM_QUALITIES = bytes((c - 33) % 256 for c in range(256))


def bam_record(name: str, seq: str, qual: str, flags: int) -> bytes:
    """An unaligned record; what stands behind a name's first space goes to the tag CO."""
    short, _, comment = name.partition(" ")
    packed = bytes.fromhex((seq.encode("ascii", "replace").translate(BAM_DIGITS) + b"0" * (len(seq) % 2)).decode())
    letters = qual.encode("latin-1")
    if letters and min(letters) < 33:
        raise ValueError(f"{name!r} has a quality below !")
    tail = b"COZ" + comment.encode("latin-1") + b"\0" if comment else b""
    raw_name = short.encode("latin-1") + b"\0"
    size = 32 + len(raw_name) + len(packed) + len(letters) + len(tail)
    return struct.pack("<iiiBBHHHiiii", size, -1, -1, len(raw_name), 0, 4680, 0, flags, len(seq), -1, -1, 0) + raw_name + packed + letters.translate(BAM_QUALITIES) + tail


#: Records that one task packs, about.
BAM_READS = 100_000


def bam_header() -> bytes:
    header = b"@HD\tVN:1.6\tSO:unsorted\n"
    return bam_block(b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 0))


def bam_packed(records: Iterable[tuple[str, str, str, int]], segments: int = 1) -> Iterable[bytes]:
    """Blocks of records (name, seq, qual, place in the molecule); with several segments they are marked as first, middle and last."""
    held = bytearray()
    for n, s, q, place in records:
        flags = UNMAPPED
        if segments > 1:
            flags |= PAIRED | MATE_UNMAPPED | (FIRST if place == 0 else 0) | (LAST if place == segments - 1 else 0)
        held += bam_record(n, s, q, flags)
        while len(held) >= 60_000:
            yield bam_block(bytes(held[:60_000]))
            del held[:60_000]
    if held:
        yield bam_block(bytes(held))


def bam_bytes(records: Iterable[tuple[str, str, str]], segments: int = 1) -> Iterable[bytes]:
    """A BAM file's bytes from records, those of a molecule one after another."""
    yield bam_header()
    yield from bam_packed(((*r, k % segments) for k, r in enumerate(records)), segments)
    yield BAM_END


def bam_parts(ordered: DataFrame, segments: int) -> DataFrame:
    """(block) of the columns name, seq, qual, and place with several segments, in their order: made by the executors, so that the driver only appends them."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for block in bam_packed(rows, segments):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    return ordered.select("name", "seq", "qual", "place" if segments > 1 else F.lit(0).alias("place")).mapInArrow(run, "block binary")


def write_reads(df: DataFrame, path: str, kind: str, compression: str = "raw", level: int | None = None, hash_raw: bool = False, hash_compressed: bool = False, segments: int = 1, order: str = "read_no") -> None:
    """Columns name, seq, qual as one file in order."""
    if kind not in SUFFIXES:
        raise ConfigError(f"unknown format '{kind}'")
    out = Output(path, "raw" if kind == "bam" else compression, level, hash_raw, hash_compressed)
    try:
        if kind == "bam":
            by = order.split(",")
            dealt = df.repartitionByRange(df.count() // BAM_READS + 1, *by).sortWithinPartitions(*by)
            parts = bam_parts(dealt, segments).persist(StorageLevel.DISK_ONLY)
            try:
                parts.count()  # all at once; the loop below asks for one partition after another
                out.write(bam_header())
                for r in parts.toLocalIterator(prefetchPartitions=True):
                    out.write(r["block"])
                out.write(BAM_END)
            finally:
                parts.unpersist()
        else:
            for r in df.orderBy(*order.split(",")).select(record_text(kind).alias("value")).toLocalIterator(prefetchPartitions=True):
                out.write(r["value"].encode("utf-8") + b"\n")
    finally:
        out.close()


def write_table(df: DataFrame, columns: list[str], path: str, compression: str = "raw") -> None:
    """A tab-separated table in order of read_no, with a line of names."""
    out = Output(path, compression)
    out.write(("\t".join(columns) + "\n").encode())
    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))
    for r in df.orderBy("read_no").select(line.alias("value")).toLocalIterator(prefetchPartitions=True):
        out.write(r["value"].encode() + b"\n")
    out.close()


def claim(paths: list[str], marker: str, patterns: list[str] = ()) -> None:
    """Refuses files that exist, also by patterns of names, unless the marker of a broken run is there; leaves the marker."""
    found = [p for p in paths if os.path.exists(p)] + [p for x in patterns for p in glob.glob(x)]
    if found and not os.path.exists(marker):
        raise FileExistsError(f"{found[0]} exists already")
    with open(marker, "w"):
        pass


