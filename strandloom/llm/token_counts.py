"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both encodings agree.

A text of at most `chunk_chars` characters is encoded whole.  A longer one is
cut into chunks that overlap; each is encoded with offsets.  Two neighbours are
spliced at a common boundary inside the overlap that is stable: both encodings
end a token at or before it and start the next at or after it, the text has a
turn there (from a visible character to white space, or between a letter and a
digit of ASCII: the pre-tokenizers end a pre-token at each such turn whatever
surrounds it, and no added token contains one), and a run of tokens on either
side is the same in both.  Without such a boundary the overlap is widened, at
once to the last turn if there is none within it.  A chunk in which no boundary
serves goes on to the next turn and is encoded once more as a whole, so a run
without turns of any length is encoded twice at most.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and null ids
each give a row; an empty table gives no rows; other columns of the input are
not read, so their names don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.common import split_batches
from strandloom.llm.wordcache import WordCache, resolve

#: Tokens on each side of a splice that both encodings must share.
AGREE = 4


#: The character before a turn.
TURN = re.compile(r"\S(?=\s)|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def stable_cut(text: str, left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], low: int, high: int) -> int | None:
    """The middle one of the stable boundaries in text[low:high], from (ids, starts, ends) of both encodings, or None."""
    (li, ls, le), (ri, rs, re_) = left, right
    found = []
    for p in (m.end() for m in TURN.finditer(text, low, high)):
        a, b = int(np.searchsorted(ls, p)), int(np.searchsorted(rs, p))  # the first tokens that start at p or later
        if a < AGREE or b < AGREE or a + AGREE > len(li) or b + AGREE > len(ri) or le[a - 1] > p or re_[b - 1] > p:
            continue
        x, y = slice(a - AGREE, a + AGREE), slice(b - AGREE, b + AGREE)
        if np.array_equal(li[x], ri[y]) and np.array_equal(ls[x], rs[y]) and np.array_equal(le[x], re_[y]):
            found.append(p)
    return found[len(found) // 2] if found else None


def last_turn(text: str, low: int, high: int) -> int | None:
    """The last turn in text[low:high], searched backwards in pieces."""
    while high > low:
        at = max(low, high - 4096)
        found = [m.end() for m in TURN.finditer(text, at, high)]
        if found:
            return found[-1]
        high = at + 1 if at > low else low
    return None


def spliced_ids(text: str, encode, chunk: int, overlap: int) -> np.ndarray:
    """Ids of text from chunks of about `chunk` characters; encode gives (ids, starts, ends) of a string."""

    def at(start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, starts, ends = encode(text[start:end])
        return ids, starts + start, ends + start

    out, start, end = [], 0, min(chunk, len(text))
    held = at(start, end)
    while end < len(text):
        width, to = overlap, min(len(text), end + chunk)
        while True:
            begin = max(start, end - width)
            if begin > start and not TURN.search(text, begin, end):
                turn = last_turn(text, start, begin)
                begin = start if turn is None else max(start, turn - overlap)
                width = end - begin
            if begin == start:  # no boundary in this chunk: on to the next turn, with what follows it as an overlap
                turn = TURN.search(text, to - 1)
                to = min(len(text), turn.end() + overlap) if turn else len(text)
                held, end = at(start, to), to
                break
            following = at(begin, to)
            cut = stable_cut(text, held, following, begin, end)
            if cut is not None:
                out.append(held[0][: np.searchsorted(held[1], cut)])
                k = np.searchsorted(following[1], cut)
                held, start, end = tuple(x[k:] for x in following), cut, to
                break
            width *= 2
    return np.concatenate([*out, held[0]])


class Counter:
    """Counts tokens of texts with one tokenizer file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, chunk: int, overlap: int):
        self.chunk, self.overlap = chunk, overlap
        if resolve(path).endswith(".model"):
            import sentencepiece

            self.pieces, self.words = sentencepiece.SentencePieceProcessor(model_file=resolve(path)), None
        else:
            self.pieces, self.words = None, WordCache.of(path)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.words.library.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(e.ids, dtype=np.int64), offsets[:, 0], offsets[:, 1]

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        out = [0] * len(texts)
        huge = [k for k, t in enumerate(texts) if len(t) > self.chunk]
        usual = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        for k in huge:
            out[k] = len(spliced_ids(texts[k], self.encoded, self.chunk, self.overlap))
        for k, ids in zip(usual, self.words.encode([texts[k] for k in usual]), strict=True):
            out[k] = len(ids) // 4
        return out


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens as the tokenizer's library gives them for the whole text, over_limit (n_tokens > limit)."""

    def run(batches):
        counter = Counter(tokenizer, chunk_chars, overlap_chars)
        for batch in split_batches(batches, text_col):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array(counter.counts(texts), dtype=np.int64)
            size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
