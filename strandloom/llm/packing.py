"""Packing of tokenised examples into training sequences: vector bin packing by the dot-product heuristic.

Each sequence has three limits at once: tokens, segments (pieces) and
loss-bearing tokens.  Sequences are filled one at a time from a window of
waiting examples: of those that fit, the one whose demands have the largest dot
product with what the sequence has left is placed, each dimension relative to
its limit.  If none fits, the one with the largest dot product is cut so that
it fills the sequence.  A task packs its own partition, so nothing is shuffled,
and it holds one window at most.  What is left at a partition's end goes to
sequences whose lengths are powers of two, which need no padding.

Null and empty texts consist of the end id alone.  Null ids and repeated rows
are documents like any other; an empty table gives no rows; other columns of
the input are not read, so their names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandloom.llm.common import small_batches, split_batches, tidy
from strandloom.llm.wordcache import WordCache

#: Sequence ids are the partition's number times this plus a number within it.
SEQUENCES = 1 << 36


class Packer:
    """Packs examples (key, ids as little-endian unsigned 32-bit bytes, number of leading ids without loss) as they come."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.window, self.sequences = window, 0
        self.keys: list = [None] * window
        self.ids: list = [b""] * window
        self.total = [0] * window
        self.prompt = [0] * window
        self.start = np.zeros(window, dtype=np.int64)
        self.tokens = np.zeros(window, dtype=np.int64)  # waiting ones of each slot; 0: a free slot
        self.loss = np.zeros(window, dtype=np.int64)
        self.free = list(range(window))

    def add(self, key, ids: bytes, prompt: int) -> Iterator[tuple]:
        """Takes an example; gives rows of the sequences which that completes."""
        while not self.free:
            yield from self.fill(int(self.limits[0]))
        k = self.free.pop()
        self.keys[k], self.ids[k], self.total[k], self.prompt[k] = key, ids, len(ids) // 4, prompt
        self.start[k], self.tokens[k], self.loss[k] = 0, len(ids) // 4, max(0, len(ids) // 4 - prompt)
        while self.tokens[k] >= self.limits[0]:
            yield from self.fill(int(self.limits[0]), first=k)

    def flush(self) -> Iterator[tuple]:
        while waiting := int(self.tokens.sum()):
            yield from self.fill(min(int(self.limits[0]), 1 << (waiting.bit_length() - 1)))

    def fill(self, capacity: int, first: int | None = None) -> Iterator[tuple]:
        """The rows of one sequence of at most `capacity` tokens."""
        left = np.array([capacity, self.limits[1], self.limits[2]], dtype=np.int64)
        at = 0
        while left[0] > 0 and left[1] > 0:
            if first is not None:
                k, first = first, None
            else:
                weight = left / self.limits**2
                dot = self.tokens * weight[0] + self.loss * weight[2]
                dot[self.tokens == 0] = -1.0
                fits = (self.tokens <= left[0]) & (self.loss <= left[2])
                k = int(np.argmax(np.where(fits, dot, -1.0)))
                if not fits[k] or self.tokens[k] == 0:
                    k = int(np.argmax(dot))  # to be cut
                    if self.tokens[k] == 0:
                        break
            start = int(self.start[k])
            silent = max(0, self.prompt[k] - start)  # ids without loss from here
            n = min(int(self.tokens[k]), int(left[0]), silent + int(left[2]))
            if n == 0:
                break  # no loss-bearing token fits any more, and this slot starts with one
            lossy = max(0, n - silent)
            piece = self.ids[k][4 * start : 4 * (start + n)]
            yield self.keys[k], start, n, zlib.crc32(piece), self.total[k], self.sequences, at, lossy, piece
            at += n
            left -= np.array([n, 1, lossy])
            self.start[k] += n
            self.tokens[k] -= n
            self.loss[k] -= lossy
            if self.tokens[k] == 0:
                self.ids[k] = b""
                self.free.append(k)
        self.sequences += 1


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, max_tokens: int = 2048, max_segments: int | None = None, max_loss: int | None = None, prompt_col: str | None = None, window: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the id, start (ids of its document before it), length, ids_crc32, doc_tokens (with the end id), sequence_id, offset in the sequence, loss_tokens; with_ids adds the ids.

    prompt_col: number of leading ids of a document that bear no loss (null: 0);
    without it all ids do.  max_segments: None sets no limit of its own, since a
    sequence of short documents would be padded for it.  Each id lies in exactly one piece.  The same
    partitions in the same order give the same sequences.
    """
    if max_tokens < 1 or any(x is not None and x < 1 for x in (max_segments, max_loss)):
        raise ValueError("limits must be positive")
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    types = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())]

    def run(batches):
        words = WordCache.of(tokenizer)
        packer = Packer(max_tokens, max_segments or max_tokens, max_loss or max_tokens, window)
        base = TaskContext.get().partitionId() * SEQUENCES
        id_type = None

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            columns[5] = [base + x for x in columns[5]]
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], types, strict=True))]
            return pa.RecordBatch.from_arrays(arrays[: 9 if with_ids else 8], [id_col, *(n for n, _ in types)][: 9 if with_ids else 8])

        rows: list[tuple] = []
        for batch in split_batches(batches, text_col):
            id_type = batch.column(0).type
            prompts = batch.column(2).to_pylist() if prompt_col else [0] * len(batch)
            for key, ids, prompt in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()]), prompts, strict=True):
                rows += packer.add(key, ids + end, prompt or 0)
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
        if id_type is not None:
            rows += packer.flush()
        if rows:
            yield batch_of(rows)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return docs.select(id_col, text_col, *([prompt_col] if prompt_col else [])).mapInArrow(tidy(run, "tokenizers"), schema + ", ids binary" * with_ids)
