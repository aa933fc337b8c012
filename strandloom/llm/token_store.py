"""Token ids on disk as directly addressable codes: any id can be read without decoding those before it.

A file is one segment of whole documents in ascending order of their ids:

    magic, partition and number of the segment, counts of documents and ids, number of levels, length of each level
    document ids with validity bytes, and the number of ids up to each document's end
    per level: chunks of 8 bits, one per id that reaches the level; a bitmap of
    which of them continue on the next level; a rank directory with the number
    of ones before each 512-bit block of the bitmap
    crc32 of all that

An id's lowest 8 bits are on level 0; the rank of its continuation bit is its
place on level 1, and so on.  Segments are written by Spark's text writer as
raw bytes (one line a file; the line's end after the checksum is not part of
the segment), so any file system Spark knows can hold them.

Null and empty texts consist of the end id alone.  Null document ids come
first; rows with the same id are ordered by their texts.  An empty table gives
no documents.  Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import maybe_broadcast, split_batches, stored
from strandloom.llm.wordcache import WordCache

MAGIC = b"DACSEG01"
HEAD = "<8sIIQQI"
HEAD_BYTES = struct.calcsize(HEAD)
#: Bits of a bitmap for which one rank is kept.
BLOCK = 512
#: Partitions whose ids are summed to one row of the driver when starts are made.
PARTS = 4096


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation bits) of each level."""
    out = []
    while True:
        more = ids > 255
        out.append(((ids & 255).astype(np.uint8), more))
        if not more.any():
            return out
        ids = ids[more] >> 8


def segment(partition: int, number: int, doc_ids: list, ends: list[int], ids: np.ndarray) -> bytes:
    levels = levels_of(ids)
    parts = [struct.pack(HEAD, MAGIC, partition, number, len(doc_ids), len(ids), len(levels)), np.array([len(c) for c, _ in levels], "<u8").tobytes()]
    parts += [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array(ends, "<u8").tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        parts += [chunks.tobytes(), bits.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """Random access to the ids of one segment's bytes."""

    def __init__(self, data: bytes):
        magic, self.partition, self.number, n_docs, self.n_ids, n_levels = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD_BYTES

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        lengths = take("<u8", n_levels).tolist()
        doc_ids, valid = take("<i8", n_docs).tolist(), take("u1", n_docs).tolist()
        self.doc_ids = [d if v else None for d, v in zip(doc_ids, valid, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = [(take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK) + 1).astype(np.int64)) for n in lengths]
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(memoryview(data)[:at]):
            raise ValueError("damaged token segment")

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk and one rank a level."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(before.sum()), shift + 8
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, found through the ranks of the first place only."""
        out = np.zeros(end - start, dtype=np.uint32)
        at, places = start, np.arange(end - start)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            n = len(places)
            if not n:
                break
            out[places] |= chunks[at : at + n].astype(np.uint32) << np.uint32(8 * level)
            block = at // BLOCK
            flags = np.unpackbits(bits[block * BLOCK // 8 : (at + n + 7) // 8], bitorder="little")
            skip = at - block * BLOCK
            places = places[flags[skip : skip + n].astype(bool)]
            at = int(ranks[block]) + int(flags[:skip].sum())
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, segment_ids: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending order of document ids, as segments under path.

    A segment ends with the document that brings it to segment_ids.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        words, partition, number = WordCache.of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ends: list[int] = []
        held: list[bytes] = []
        size = 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([segment(partition, number, doc_ids, ends, np.frombuffer(b"".join(held), "<u4"))], pa.binary())], ["segment"])

        for batch in split_batches(batches, text_col):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                held += [ids, end]
                size += len(ids) // 4 + 1
                doc_ids.append(doc_id)
                ends.append(size)
                if size >= segment_ids:
                    yield made()
                    doc_ids, ends, held, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield made()

    key = F.col(id_col)
    dealt = docs.select(key.cast("long").alias(id_col), text_col).repartitionByRange(key.asc_nulls_first()).sortWithinPartitions(key.asc_nulls_first(), F.col(text_col).asc_nulls_first())
    segments = dealt.mapInArrow(run, "segment binary")
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the segments under path: its id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file is read once.  What stands before a segment is summed on executors from the rows found, so that the driver
    keeps a row only for every PARTS partitions that were written.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 4")

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                s = Segment(data.as_py())
                begins = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(s.ids(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(begins, s.ends, strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([s.partition] * n, pa.int64()), pa.array([s.number] * n, pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(begins), pa.array(s.ends - begins), pa.array(sums, pa.int64())], ["part", "number", id_col, "local", "n_tokens", "ids_crc32"])

    rows = stored(files.select("content").mapInArrow(run, f"part long, number long, `{id_col}` long, local long, n_tokens long, ids_crc32 long"), "token-rows")
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    inside = Window.partitionBy("part").orderBy("number")
    segments = sizes.select("part", "number", (F.sum("size").over(inside) - F.col("size")).alias("before"), F.floor(F.col("part") / PARTS).alias("block"), "size")
    whole = segments.groupBy("block", "part").agg(F.sum("size").alias("size"))
    blocks = sorted((r["block"], r["size"]) for r in whole.groupBy("block").agg(F.sum("size").alias("size")).collect())
    firsts = spark.createDataFrame([(b, sum(n for _, n in blocks[:k])) for k, (b, _) in enumerate(blocks)], "block long, first long")
    parts = whole.join(F.broadcast(firsts), "block").select("part", (F.col("first") + F.sum("size").over(Window.partitionBy("block").orderBy("part")) - F.col("size")).alias("earlier"))
    bases = stored(segments.join(parts, "part").select("part", "number", (F.col("earlier") + F.col("before")).alias("base")), "token-bases")
    return rows.join(maybe_broadcast(bases, 32), ["part", "number"]).select(id_col, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
