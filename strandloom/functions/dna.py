"""Column functions over bases: complements, IUPAC classes, distances, hits that follow an edit."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.model import HIT

#: The bases that each IUPAC letter stands for.
IUPAC = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "U": "U",
    "R": "AG",
    "Y": "CT",
    "S": "GC",
    "W": "AT",
    "K": "GT",
    "M": "AC",
    "B": "CGT",
    "V": "ACG",
    "D": "AGT",
    "H": "ACT",
    "N": "ACGTN",
}
#: Each letter and its complement.
FORWARD, COMPLEMENT = "ACGTURYSWKMBVDHN", "TGCAAYRSWMKVBHDN"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, FORWARD + FORWARD.lower(), COMPLEMENT + COMPLEMENT.lower()))


def reverse_complement_text(seq: str) -> str:
    return seq.translate(str.maketrans(FORWARD + FORWARD.lower(), COMPLEMENT + COMPLEMENT.lower()))[::-1]


def letter_class(letter: str) -> str | None:
    """Upper-case bases a pattern's letter accepts; None: anything."""
    letter = letter.upper()
    return None if letter == "N" else IUPAC[letter]


def iupac_regex(pattern: str) -> str:
    return "(?is)" + "".join("." if letter_class(x) is None else f"[{letter_class(x)}]" for x in pattern)


def iupac_overlap(a: str, b: str) -> bool:
    """Whether some sequence fits both patterns."""
    return len(a) == len(b) and all(letter_class(x) is None or letter_class(y) is None or set(letter_class(x)) & set(letter_class(y)) for x, y in zip(a, b, strict=True))


def iupac_distance(window: Column, pattern: str) -> Column:
    """Letters of a window as long as the pattern that the pattern doesn't accept."""
    terms = [F.when(F.upper(F.substring(window, k + 1, 1)).isin(*accepted), 0).otherwise(1) for k, x in enumerate(pattern) if (accepted := letter_class(x)) is not None]
    return reduce(add, terms, F.lit(0))


def hamming(window: Column, text: str) -> Column:
    """Differing letters of a window as long as the text."""
    return reduce(add, [F.when(F.substring(window, k + 1, 1) == x, 0).otherwise(1) for k, x in enumerate(text)], F.lit(0))


def hit(segment: int, start: Column, length: Column, sequence: Column) -> Column:
    return F.struct(F.lit(segment).cast("int").alias("segment"), start.cast("int").alias("start"), length.cast("int").alias("len"), sequence.alias("sequence"))


def one_hit(found: Column, segment: int, start: Column, length: Column, sequence: Column) -> Column:
    """A Location value of one hit where found, else null."""
    return F.when(found, F.array(hit(segment, start, length, sequence)))


def placeless(h: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(none.alias("segment"), none.alias("start"), none.alias("len"), h["sequence"].alias("sequence"))


def moved(hits: Column, segment: int | Column, lost: Callable[[Column], Column], start: Callable[[Column], Column], sequence: Callable[[Column], Column] | None = None) -> Column:
    """Hits after an edit of a segment: if one of them is lost there, all lose their places, else starts change."""
    here = lambda h: h["segment"] == segment
    after = lambda h: F.struct(h["segment"].alias("segment"), start(h).cast("int").alias("start"), h["len"].alias("len"), (sequence(h) if sequence else h["sequence"]).alias("sequence"))
    gone = F.exists(hits, lambda h: here(h) & lost(h))
    return F.when(gone, F.transform(hits, placeless)).otherwise(F.transform(hits, lambda h: F.when(here(h), after(h)).otherwise(h.cast(HIT))))


def ranges_regex(low: int, high: int) -> str:
    """A regular expression's class of the characters from low to high."""
    return f"[{re.escape(chr(low))}-{re.escape(chr(high))}]"
