"""Tags with places: patterns, regions, tails and runs of low quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import vectorised
from strandloom.functions.dna import hamming, hit, iupac_distance, iupac_regex, one_hit
from strandloom.model import HITS, ConfigError, Reads, TagType, joined_sequence, name, qual, seq, tag


def _at(reads: Reads, segment: str, found: Column, start: Column, length: Column) -> Column:
    return one_hit(found, reads.index(segment), start, length, F.substring(seq(segment), start + 1, length))


def iupac(reads: Reads, segment: str, patterns: list[str], anchor: str, max_mismatches: int, out_label: str) -> Reads:
    """The first pattern of the list that matches: at the read's start, its end, or in its leftmost best window."""
    size, values, df = F.length(seq(segment)), [], reads.df
    helpers = []
    for k, p in enumerate(patterns):
        n = len(p)
        if anchor == "anywhere" and max_mismatches:
            df = df.withColumn(f"_at{k}", vectorised.iupac_anywhere(seq(segment), p, max_mismatches))
            helpers.append(f"_at{k}")
            start = F.col(f"_at{k}")
            found = start.isNotNull()
        elif anchor == "anywhere":
            start = F.regexp_instr(seq(segment), F.lit(iupac_regex(p))) - 1
            found = start >= 0
        else:
            start = F.lit(0) if anchor == "left" else size - n
            found = (size >= n) & (iupac_distance(F.substring(seq(segment), start + 1, F.lit(n)), p) <= max_mismatches)
        values.append(_at(reads, segment, found, start, F.lit(n)))
    out = reads.with_df(df).with_tag(out_label, TagType.LOCATION, F.coalesce(*values))
    return out.with_df(out.df.drop(*helpers))


def iupac_with_indel(reads: Reads, segment: str, patterns: list[str], anchor: str, out_label: str, max_mismatches: int = 0, max_indel_bases: int = 0, max_total_edits: int | None = None) -> Reads:
    """The first pattern that aligns to the read within the limits."""
    total = max_mismatches + max_indel_bases if max_total_edits is None else max_total_edits
    df, values = reads.df, []
    for k, p in enumerate(patterns):
        df = df.withColumn(f"_at{k}", vectorised.iupac_with_indels(seq(segment), p, anchor, max_mismatches, max_indel_bases, total))
        values.append(_at(reads, segment, F.col(f"_at{k}.start").isNotNull(), F.col(f"_at{k}.start"), F.col(f"_at{k}.len")))
    out = reads.with_df(df).with_tag(out_label, TagType.LOCATION, F.coalesce(*values))
    return out.with_df(out.df.drop(*(f"_at{k}" for k in range(len(patterns)))))


def iupac_suffix(reads: Reads, segment: str, pattern: str, min_length: int, max_mismatches: int, out_label: str) -> Reads:
    """The longest end of the read that begins the pattern, by plain distance; the hit is as long as that end."""
    if not 0 < min_length <= len(pattern) or not set(pattern) <= set("ACGT"):
        raise ConfigError("min_length must be within the pattern, which has only A, C, G and T")
    size, values = F.length(seq(segment)), []
    for n in range(len(pattern), min_length - 1, -1):
        start = size - n
        found = (size >= n) & (hamming(F.substring(seq(segment), start + 1, F.lit(n)), pattern[:n]) <= max_mismatches)
        values.append(_at(reads, segment, found, start, F.lit(n)))
    return reads.with_tag(out_label, TagType.LOCATION, F.coalesce(*values))


def java_replacement(text: str) -> str:
    """A replacement with $1 and ${name}: groups by number stay, literal backslashes are escaped."""
    if "$1_" in text:
        raise ConfigError("write ${1}_ instead of $1_")
    out = text.replace("\\", "\\\\")
    for k in range(10):
        out = out.replace(f"${{{k}}}", f"${k}")
    return out


def regex(reads: Reads, source: str, search: str, out_label: str, replacement: str = "$0") -> Reads:
    """The first match: a place and the expanded replacement in a segment, the replacement alone in a name."""
    named = source.startswith("name:")
    segment = source.removeprefix("name:")
    text = name(segment) if named else seq(segment)
    start = F.regexp_instr(text, F.lit(search)) - 1
    whole = F.regexp_substr(text, F.lit(search))
    # the match is expanded at the start of the rest of the text; what stands behind it is cut off again
    rest = F.substring(text, start + 1, F.lit(1 << 30))
    expanded = F.regexp_replace(rest, F.lit(f"(?s)\\A(?:{search})"), F.lit(java_replacement(replacement)))
    value = F.substring(expanded, F.lit(1), F.length(expanded) - F.length(rest) + F.length(whole))
    found = start >= 0
    if named:
        return reads.with_tag(out_label, TagType.STRING, F.when(found, value))
    return reads.with_tag(out_label, TagType.LOCATION, one_hit(found, reads.index(segment), start, F.length(whole), value))


@dataclass(frozen=True)
class Region:
    source: str  # a segment, tag:<label> or name:<segment>
    start: int
    length: int
    anchor: str = "start"


def regions(reads: Reads, wanted: list[Region], out_label: str) -> Reads:
    """Substrings by place; if one is out of bounds, the tag is missing.

    All from segments, or all tags among the sources being Location tags: a
    Location tag.  Else the pieces joined to a String.
    """
    tags = [r.source[4:] for r in wanted if r.source.startswith("tag:")]
    for t in tags:
        if reads.tags.get(t) not in (TagType.LOCATION, TagType.STRING):
            raise ConfigError(f"unknown or unfit tag '{t}'")
    segments_only = all(":" not in r.source for r in wanted)
    as_location = segments_only or (bool(tags) and all(reads.tags[t] is TagType.LOCATION for t in tags) and not any(r.source.startswith("name:") for r in wanted))
    hits, fine = [], F.lit(True)
    for r in wanted:
        segment_no = F.lit(None).cast("int")
        if r.source.startswith("tag:") and reads.tags[r.source[4:]] is TagType.LOCATION:
            first = F.get(tag(r.source[4:]), F.lit(0))
            segment_no = first["segment"]
            text = F.get(F.array(*(seq(s) for s in reads.segments)), segment_no)
            at = F.least(first["start"] + r.start, F.length(text)) if r.anchor == "start" else first["start"] + first["len"] + r.start
        else:
            if r.source.startswith("tag:"):
                text = tag(r.source[4:])
            elif r.source.startswith("name:"):
                text = name(r.source[5:])
            else:
                text, segment_no = seq(r.source), F.lit(reads.index(r.source))
            at = F.lit(r.start) if r.anchor == "start" and r.start >= 0 else F.length(text) + r.start
        size = F.length(text)
        fine = fine & F.coalesce((at >= 0) & (at < size) & (at + r.length <= size), F.lit(False))
        piece = F.substring(text, at + 1, F.lit(r.length))
        hits.append(F.struct(segment_no.cast("int").alias("segment"), at.cast("int").alias("start"), F.lit(r.length).cast("int").alias("len"), piece.alias("sequence")))
    value = F.array(*hits)
    if as_location:
        return reads.with_tag(out_label, TagType.LOCATION, F.when(fine, value), many=len(wanted) > 1)
    return reads.with_tag(out_label, TagType.STRING, F.when(fine, joined_sequence(value)))


def poly_tail(reads: Reads, segment: str, base: str, min_length: int, max_mismatch_rate: float, max_consecutive_mismatches: int, out_label: str) -> Reads:
    if min_length < 2 or not 0 <= max_mismatch_rate < 1:
        raise ConfigError("min_length must be at least 2 and max_mismatch_rate in [0, 1)")
    size = F.length(seq(segment))
    if max_mismatch_rate == 0 and base != ".":  # exact: the run of one base at the end
        start = F.length(F.rtrim(seq(segment), F.lit(base)))
        return reads.with_tag(out_label, TagType.LOCATION, _at(reads, segment, size - start >= min_length, start, size - start))
    df = reads.df.withColumn("_at", vectorised.poly_tail(seq(segment), base, min_length, max_mismatch_rate, max_consecutive_mismatches))
    out = reads.with_df(df).with_tag(out_label, TagType.LOCATION, _at(reads, segment, F.col("_at").isNotNull(), F.col("_at"), size - F.col("_at")))
    return out.with_df(out.df.drop("_at"))


def longest_poly_x(reads: Reads, segment: str, base: str, min_length: int, max_mismatch_rate: float, max_consecutive_mismatches: int, out_label: str) -> Reads:
    if min_length < 1 or not 0 <= max_mismatch_rate < 1:
        raise ConfigError("min_length must be positive and max_mismatch_rate in [0, 1)")
    df = reads.df.withColumn("_at", vectorised.longest_poly(seq(segment), base, min_length, max_mismatch_rate, max_consecutive_mismatches))
    out = reads.with_df(df).with_tag(out_label, TagType.LOCATION, _at(reads, segment, F.col("_at.start").isNotNull(), F.col("_at.start"), F.col("_at.len")))
    return out.with_df(out.df.drop("_at"))


def bytes_between(low: int, high: int) -> str:
    return "".join(map(chr, range(low, high + 1)))


def low_quality_start(reads: Reads, segment: str, min_qual: int, out_label: str) -> Reads:
    """The longest beginning whose qualities are below min_qual."""
    n = F.length(qual(segment)) - F.length(F.ltrim(qual(segment), F.lit(bytes_between(33, min_qual - 1))))
    return reads.with_tag(out_label, TagType.LOCATION, _at(reads, segment, n > 0, F.lit(0), n))


def low_quality_end(reads: Reads, segment: str, min_qual: int, out_label: str) -> Reads:
    start = F.length(F.rtrim(qual(segment), F.lit(bytes_between(33, min_qual - 1))))
    n = F.length(qual(segment)) - start
    return reads.with_tag(out_label, TagType.LOCATION, _at(reads, segment, n > 0, start, n))


def regions_of_low_quality(reads: Reads, segment: str, min_quality: int, min_length: int, out_label: str) -> Reads:
    """All longest runs of at least min_length qualities below min_quality."""
    k = reads.index(segment)
    low = bytes_between(33, min_quality - 1)
    marked = F.translate(qual(segment), low, "\x01" * len(low))  # each run becomes one of \x01
    parts = F.split(F.regexp_replace(marked, "(\x01+)", "\x02$1\x02"), "\x02")
    # runs and what lies between alternate, runs at the odd places; a running sum of lengths gives their starts
    seen = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("hits")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(F.startswith(p, F.lit("\x01")) & (F.length(p) >= min_length), F.concat(acc["hits"], F.array(hit(k, acc["at"], F.length(p), F.substring(seq(segment), acc["at"] + 1, F.length(p)))))).otherwise(acc["hits"]).alias("hits"),
        ),
    )["hits"]
    return reads.with_tag(out_label, TagType.LOCATION, F.when(F.size(seen) > 0, seen), many=True)
