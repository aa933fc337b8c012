"""Exact tokenisation through the tokenizers library, with each distinct pre-token encoded once per process.

Both vocabularies that are served cut a text into pre-tokens with a fixed
pattern and apply BPE within each, so ids of a text are the joined ids of its
pre-tokens.  Here that pattern is evaluated by `re` on texts of Latin-1
characters, where the classes of letters and digits are known and
normalisation maps each character to itself; the ids of a pre-token come from
the library.  All other texts, and those which contain the string of a special
token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from strandloom.llm.common import process_cache

#: Letters and digits among the Latin-1 characters (Unicode categories L and N).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: White space on which `re` and the library agree; a text with other control characters goes to the library.
UNSURE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0Ā-\U0010ffff]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-token patterns by the kind of tokenizer file.
PATTERNS = {
    "bytes": rf"{ENDINGS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+",
    "words": rf"{ENDINGS}|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+",
}
#: Distinct pre-tokens kept per process in each of two generations (about 200 bytes each).
CACHE_WORDS = 200_000


def resolve(tokenizer: str) -> str:
    """A path as it is, or the place of a file of the installed package of public tokenizers."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def byte_letters() -> list[str]:
    """The character by which byte-level BPE stands for each byte: itself if visible, else the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class PieceIds(dict):
    """Pre-token to ids, asked from the library's BPE model at first sight; those not seen for two generations are forgotten."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, dict(enumerate(byte_letters()))
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        known = self.older.get(piece)
        if known is not None:
            self[piece] = known
            return known
        as_bytes = piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(as_bytes)])
        return ids


class WordCache:
    """Ids of whole texts exactly as tokenizers gives them, without special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = resolve(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [x["content"] for x in described["added_tokens"]]
        self.lower = described["normalizer"] is not None
        kind = self._kind(described)
        self.find = re.compile(PATTERNS[kind]).findall if kind else None
        self.ids = PieceIds(self.library.model)

    @staticmethod
    def _kind(described: dict) -> str | None:
        """Which known pattern the file describes; None: the library does everything."""
        pre, norm = described["pre_tokenizer"] or {}, described["normalizer"]
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "bytes"
        if norm and [x["type"] for x in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            first = pre["pretokenizers"][0]
            if first.get("pattern", {}).get("Regex") == ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and first.get("invert"):
                return "words"
        return None

    @classmethod
    def of(cls, path: str) -> WordCache:
        cache = process_cache("tokenizers")
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        slow = []
        piece_ids = self.ids.__getitem__
        for k, t in enumerate(texts):
            if self.find is None or UNSURE.search(t) or any(s in t for s in self.special):
                slow.append(k)
            else:
                out[k] = b"".join(map(piece_ids, self.find(t.lower() if self.lower else t)))
        if slow:
            for k, e in zip(slow, self.library.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out
