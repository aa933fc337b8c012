"""Checks that stop a run, whatever the sinks read: each is a filter that keeps all rows or raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.model import ConfigError, Reads, TagType, insisting, joined_sequence, name, qual, seq, tag
from strandloom.operators.edits import ENCODINGS, encoding


def sequences(reads: Reads, segment: str, allowed: str) -> Reads:
    for s in reads.segments if segment == "all" else (segment,):
        fine = F.translate(seq(s), allowed, "") == ""
        reads = insisting(reads, fine, F.concat(F.lit("ValidateSeq: letters that aren't allowed in "), name(s)))
    return reads


def qualities(reads: Reads, segment: str, encoding_: str) -> Reads:
    _, low, high = ENCODINGS[encoding(encoding_)]
    for s in reads.segments if segment == "all" else (segment,):
        fine = F.regexp_like(qual(s), F.lit(f"^[\\x{low:02x}-\\x{high:02x}]*$"))
        reads = insisting(reads, fine, F.concat(F.lit("ValidateQuality: bytes outside the encoding in "), name(s)))
    return reads


def _sampled(reads: Reads, stride: int, fine: Column, message: str) -> Reads:
    """A check of every stride-th molecule that reaches this point."""
    if len(reads.segments) < 2:
        raise ConfigError("at least two segments are needed")
    counted = reads.running_index()
    first = reads.segments[0]
    out = insisting(counted, (F.col("_index") % stride != 0) | fine, F.concat(F.lit(message), name(first)))
    return out.with_df(out.df.drop("_index"))


def names(reads: Reads, readname_end_char: str | None = None, sample_stride: int = 1000) -> Reads:
    """Names of all segments are equal up to a character, which they must have."""
    fine = F.lit(True)
    for s in reads.segments:
        whole = F.contains(name(s), F.lit(readname_end_char)) if readname_end_char else F.lit(True)
        end = (lambda c: F.substring_index(c, readname_end_char, 1)) if readname_end_char else (lambda c: c)
        fine = fine & (F.length(name(s)) > 0) & whole & (end(name(s)) == end(name(reads.segments[0])))
    return _sampled(reads, sample_stride, fine, "ValidateName: names of the segments differ at ")


def read_pairing(reads: Reads, sample_stride: int = 1000) -> Reads:
    """Names of all segments are equally long and differ in one letter at most."""
    fine, first = F.lit(True), name(reads.segments[0])
    for s in reads.segments[1:]:
        differing = F.aggregate(F.zip_with(F.split(first, ""), F.split(name(s), ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda a, d: a + d)
        fine = fine & (F.length(first) == F.length(name(s))) & (differing <= 1)
    return _sampled(reads, sample_stride, fine, "ValidateReadPairing: names of the segments differ at ")


def same_length(reads: Reads, source: str) -> Reads:
    """All molecules have the same length of a segment, of all together, of a tag or of a name; missing tags are left out.

    An aggregate of one row is joined to the reads, so the check runs with them.
    """
    if source.startswith("tag:"):
        label = source[4:]
        size = F.length(joined_sequence(tag(label)) if reads.tags[label] is TagType.LOCATION else tag(label))
    elif source.startswith("name:"):
        size = F.length(name(source[5:]))
    else:
        size = sum((F.length(seq(s)) for s in (reads.segments if source == "all" else (source,))), F.lit(0))
    seen = reads.df.agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    joined = reads.with_df(reads.df.join(F.broadcast(seen)))
    fine = F.col("_low").isNull() | (F.col("_low") == F.col("_high"))
    out = insisting(joined, fine, F.concat(F.lit("ValidateAllReadsSameLength: lengths from "), F.col("_low").cast("string"), F.lit(" to "), F.col("_high").cast("string")))
    return out.with_df(out.df.drop("_low", "_high"))
