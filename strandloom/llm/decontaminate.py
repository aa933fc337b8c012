"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows scans each text once.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII.  Every word of the benchmark gets a code of as many symbols as all
others, symbols of different places in a code being different, so that the
automaton runs over words and can match at word starts only; a word the
benchmark doesn't have becomes an unknown code.  The place of a match divided
by the length of a code is a word's number, and words know their offsets in the
original text.

A window is `window` consecutive words of an item; an item of fewer words, but
not none, is one window.  A text's words inside any occurrence of any window
are hit.  A text is contaminated if it has hits and they are at least one in
`one_in` of its words.

The benchmark is cut into shards of at most `shard_bytes` of text, one automaton
each, so that neither driver nor workers hold more; with several shards the
texts are scanned once for each, and the matches of the scans are joined.

Null and empty texts have no words: no hits, not contaminated.  Items that are
null or without words have no windows.  Items with a null id mark words, but
are not counted or named.  Rows of the benchmark that repeat an id are one item
by name.  Empty tables on either side are fine.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, process_cache, small_batches, split_batches, stored, tidy

#: Each byte as it stands among words: A-Z lower-cased, other ASCII beside digits and a-z a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Symbols a place of a code has.
BASE = 64


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


class Windows:
    """The automaton over one shard: a list of (item id, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        split = [(i, words_of(t)) for i, t in items]
        vocabulary = dict.fromkeys(w for _, words in split for w in words)
        self.width = 1
        while BASE**self.width < len(vocabulary):
            self.width += 1
        self.code = {w: "".join(chr(256 + BASE * p + k // BASE**p % BASE) for p in range(self.width)) for k, w in enumerate(vocabulary)}
        self.unknown = "\x01" * self.width
        owners: dict[tuple[bytes, ...], set] = {}
        for i, words in split:
            n = min(window, len(words))
            for k in range(len(words) - n + 1 if n else 0):
                owners.setdefault(tuple(words[k : k + n]), set()).add(i)
        self.found = ahocorasick.Automaton()
        for words, ids in owners.items():
            self.found.add_word("".join(map(self.code.__getitem__, words)), (len(words), frozenset(ids - {None})))
        if owners:
            self.found.make_automaton()
        self.any = bool(owners)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ascending ranges of hit words, and the items with windows there."""
        if not self.any or not words:
            return [], set()
        ranges: list[list[int]] = []
        items: set[str] = set()
        for end, (n, ids) in self.found.iter("".join(map(self.code.get, words, repeat(self.unknown)))):
            last = (end + 1) // self.width
            first = last - n
            while ranges and ranges[-1][1] >= first:
                first = min(first, ranges.pop()[0])
            ranges.append([first, last])
            items |= ids
        return [(a, b) for a, b in ranges], items


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """The benchmark as lists of (id as string, text), streamed through the driver, each of at most about shard_bytes."""
    held, size = [], 0
    for i, t in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        if held and size + len(t) > shard_bytes:
            yield held
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    yield held


def _scan(docs: DataFrame, items, window: int, text_col: str):
    """A function of batches of docs that adds the matches of one shard to the columns __ranges and __items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place = docs.columns.index(text_col)
    token = uuid.uuid4().hex

    def run(batches):
        cache = process_cache("windows")
        if token not in cache:
            cache.clear()  # one automaton a worker
            cache[token] = Windows(shared.value, window)
        windows = cache[token]
        for batch in split_batches(batches, text_col):
            ranges, found = [], []
            for t, old, ids in zip(batch.column(place).to_pylist(), batch.column(-2 + batch.num_columns).to_pylist(), batch.column(-1 + batch.num_columns).to_pylist(), strict=True):
                r, i = windows.scan(words_of(t))
                ranges.append([x for p in joined([*zip(old[::2], old[1::2], strict=True), *r]) for x in p] if old else [x for p in r for x in p])
                found.append(sorted(i | {*ids}))
            arrays = [*batch.columns[:-2], pa.array(ranges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, shard_bytes: int = 1 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans (start, end: characters of the text) of hit words.

    Columns of docs with these names are replaced.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans", "__ranges", "__items"]
    keep = docs.drop(*new)
    found = keep.withColumns({"__ranges": F.expr("cast(array() as array<int>)"), "__items": F.expr("cast(array() as array<string>)")})
    for k, items in enumerate(shards(benchmark, item_id, item_text, shard_bytes)):
        if k:
            before, found = found, stored(found.mapInArrow(tidy(scan, "windows"), found.schema), "decontaminate")
            if k > 1:
                discard(before)
        scan = _scan(found, items, window, text_col)
    place = keep.columns.index(text_col)

    def run(batches):
        for batch in scan(batches):  # in the same worker: two a task would stay for the rest of the session
            rows = []
            for t, flat, ids in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                n = len(words_of(t))
                hit = sum(flat[1::2]) - sum(flat[::2])
                spans = []
                if flat:
                    at = [m.span() for m in WORD.finditer(t)]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(flat[::2], flat[1::2], strict=True)]
                rows.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and one_in * hit >= n, ids, spans))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*batch.schema.names[:-2], *new[:7]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)
    return found.mapInArrow(tidy(run, "windows"), f"{schema}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:int,end:int>>")


def clean_of_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns, whatever their names."""
    apart = {c: f"__docs_{k}" for k, c in enumerate(docs.columns)}
    found = find_benchmark(docs.withColumnsRenamed(apart), benchmark, text_col=apart[text_col], **options)
    return found.where("not contaminated").select(*(F.col(n).alias(c) for c, n in apart.items()))
