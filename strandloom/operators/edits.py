"""Edits of reads.  Hits on the edited segment follow; where one is cut away, its tag's hits lose their places."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.dna import moved, placeless, reverse_complement
from strandloom.functions.vectorised import merge_reads as merged
from strandloom.model import ConfigError, Reads, TagType, insisting, joined_sequence, name, qual, read, seq, tag, truth

#: Offset, lowest and highest byte of each encoding of qualities.
ENCODINGS = {"sanger": (33, 33, 126), "solexa": (64, 59, 126), "illumina13": (64, 64, 126)}
ALIASES = {"illumina1.8": "sanger", "illumina18": "sanger", "illumina1.3": "illumina13"}


def encoding(text: str) -> str:
    low = text.lower()
    low = ALIASES.get(low, low)
    if low not in ENCODINGS:
        raise ConfigError(f"unknown encoding '{text}'")
    return low


def condition(reads: Reads, if_tag: str | None) -> Column | None:
    if if_tag is None:
        return None
    wanted = truth(reads, if_tag.removeprefix("!"))
    return ~wanted if if_tag.startswith("!") else wanted


def edited(reads: Reads, segment: str, new_seq: Column, new_qual: Column, if_tag: str | None, hits=None) -> Reads:
    """The segment with new sequence and quality where the condition holds; hits: label -> its new value."""
    where = condition(reads, if_tag)
    new = read(name(segment), new_seq, new_qual)
    columns = {segment: new if where is None else F.when(where, new).otherwise(F.col(f"`{segment}`"))}
    for label in reads.locations() if hits else ():
        value = hits(label, tag(label))
        columns[f"t_{label}"] = value if where is None else F.when(where, value).otherwise(tag(label))
    return reads.with_df(reads.df.withColumns(columns))


def cut_start(reads: Reads, segment: str, n: int, if_tag: str | None = None) -> Reads:
    k = reads.index(segment)
    rest = lambda c: F.substring(c, n + 1, 1 << 30)
    return edited(reads, segment, rest(seq(segment)), rest(qual(segment)), if_tag, lambda _, v: moved(v, k, lambda h: h["start"] < n, lambda h: h["start"] - n))


def _shortened(reads: Reads, segment: str, size: Column, if_tag: str | None) -> Reads:
    """The first `size` letters; hits that end beyond lose their places in all rows that are that short."""
    # in the body of a lambda a segment's name would mean the new segment beside it, so its size stands apart
    reads = reads.with_df(reads.df.withColumn("_size", size))
    size = F.col("_size")
    k = reads.index(segment)
    where = condition(reads, if_tag)
    left = lambda c: F.substring(c, F.lit(1), size)
    new = read(name(segment), left(seq(segment)), left(qual(segment)))
    columns = {segment: new if where is None else F.when(where, new).otherwise(F.col(f"`{segment}`"))}
    columns |= {f"t_{label}": moved(tag(label), k, lambda h: h["start"] + h["len"] > size, lambda h: h["start"]) for label in reads.locations()}
    return reads.with_df(reads.df.withColumns(columns).drop("_size"))


def cut_end(reads: Reads, segment: str, n: int, if_tag: str | None = None) -> Reads:
    return _shortened(reads, segment, F.greatest(F.length(seq(segment)) - n, F.lit(0)), if_tag)


def truncate(reads: Reads, segment: str, n: int, if_tag: str | None = None) -> Reads:
    return _shortened(reads, segment, F.least(F.length(seq(segment)), F.lit(n)), if_tag)


def prefix(reads: Reads, segment: str, bases: str, quality: str, if_tag: str | None = None) -> Reads:
    if len(bases) != len(quality):
        raise ConfigError("seq and qual must have the same length")
    k, n = reads.index(segment), len(bases)
    return edited(reads, segment, F.concat(F.lit(bases), seq(segment)), F.concat(F.lit(quality), qual(segment)), if_tag, lambda _, v: moved(v, k, lambda h: F.lit(False), lambda h: h["start"] + n))


def postfix(reads: Reads, segment: str, bases: str, quality: str, if_tag: str | None = None) -> Reads:
    if len(bases) != len(quality):
        raise ConfigError("seq and qual must have the same length")
    return edited(reads, segment, F.concat(seq(segment), F.lit(bases)), F.concat(qual(segment), F.lit(quality)), if_tag)


def reverse_complement_step(reads: Reads, segment: str, if_tag: str | None = None) -> Reads:
    k = reads.index(segment)
    reads = reads.with_df(reads.df.withColumn("_size", F.length(seq(segment))))
    size = F.col("_size")
    turned = lambda _, v: moved(v, k, lambda h: F.lit(False), lambda h: size - h["start"] - h["len"], lambda h: reverse_complement(h["sequence"]))
    out = edited(reads, segment, reverse_complement(seq(segment)), F.reverse(qual(segment)), if_tag, turned)
    return out.with_df(out.df.drop("_size"))


def quality_table(from_: str, to: str) -> tuple[str, str]:
    """The letters of one encoding and what each becomes in another."""
    (off, low, high), (to_off, to_low, to_high) = ENCODINGS[from_], ENCODINGS[to]
    letters, becomes = [], []
    for b in range(low, high + 1):
        q = b - off
        if from_ == "solexa" and to != "solexa":
            q = math.floor(10 * math.log10(10 ** (q / 10) + 1) + 0.5)
        elif to == "solexa" and from_ != "solexa":
            x = 10 ** (q / 10) - 1
            value = 10 * math.log10(x) if x > 0 else -math.inf
            q = -(10**6) if value == -math.inf else int(math.copysign(math.floor(abs(value) + 0.5), value))
        letters.append(chr(b))
        becomes.append(chr(min(max(q + to_off, to_low), to_high)))
    return "".join(letters), "".join(becomes)


def convert_quality(reads: Reads, from_: str, to: str) -> Reads:
    """All segments' qualities in another encoding; bytes outside the first one's limits are an error."""
    from_, to = encoding(from_), encoding(to)
    if from_ == to:
        raise ConfigError("from and to are the same encoding")
    old, new = quality_table(from_, to)
    _, low, high = ENCODINGS[from_]
    columns = {}
    for s in reads.segments:
        fine = F.regexp_like(qual(s), F.lit(f"^[\\x{low:02x}-\\x{high:02x}]*$"))
        reads = insisting(reads, fine, F.concat(F.lit(f"quality outside {from_}: "), qual(s)))
        columns[s] = read(name(s), seq(s), F.translate(qual(s), old, new))
    return reads.with_df(reads.df.withColumns(columns))


def rename(reads: Reads, search: str, replacement: str) -> Reads:
    """Names of all segments by a regular expression; {{READ_INDEX}} counts the reads that reach this point."""
    counted = "{{READ_INDEX}}" in replacement
    reads = reads.running_index() if counted else reads
    columns = {}
    for s in reads.segments:
        new = F.regexp_replace(name(s), search, replacement.replace("{{READ_INDEX}}", "\x01"))
        columns[s] = read(F.replace(new, F.lit("\x01"), F.col("_index").cast("string")) if counted else new, seq(s), qual(s))
    df = reads.df.withColumns(columns)
    return reads.with_df(df.drop("_index") if counted else df)


def swap(reads: Reads, a: str, b: str, if_tag: str | None = None) -> Reads:
    """Exchanges two segments' reads; hits move with them."""
    if a == b:
        raise ConfigError("a segment can't be swapped with itself")
    where, i, j = condition(reads, if_tag), reads.index(a), reads.index(b)
    when = lambda new, old: new if where is None else F.when(where, new).otherwise(old)
    other = lambda h: F.when(h["segment"] == i, j).when(h["segment"] == j, i).otherwise(h["segment"]).cast("int")
    turned = lambda v: F.transform(v, lambda h: F.struct(other(h).alias("segment"), h["start"].alias("start"), h["len"].alias("len"), h["sequence"].alias("sequence")))
    columns = {a: when(F.col(f"`{b}`"), F.col(f"`{a}`")), b: when(F.col(f"`{a}`"), F.col(f"`{b}`"))}
    columns |= {f"t_{x}": when(turned(tag(x)), tag(x)) for x in reads.locations()}
    return reads.with_df(reads.df.withColumns(columns))


def change_case(reads: Reads, target: str, upper: bool, if_tag: str | None = None) -> Reads:
    """Case of a segment's bases, of all segments', of a tag's hit sequences, or of names before their comment."""
    case = F.upper if upper else F.lower
    if target.startswith("tag:"):
        label = target[4:]
        if reads.tags.get(label) is TagType.LOCATION:
            changed = F.transform(tag(label), lambda h: F.struct(h["segment"].alias("segment"), h["start"].alias("start"), h["len"].alias("len"), case(h["sequence"]).alias("sequence")))
            return reads.with_df(reads.df.withColumn(f"t_{label}", changed))
        if label not in reads.tags:
            raise ConfigError(f"unknown tag '{label}'")
        return reads
    where = condition(reads, if_tag)
    named = target.startswith("name:")
    chosen = target.removeprefix("name:")
    columns = {}
    for s in reads.segments if chosen == "all" else (chosen,):
        if named:
            at = F.instr(name(s), reads.comment)
            new = F.when(at > 0, F.concat(case(F.substring(name(s), F.lit(1), at - 1)), F.substring(name(s), at, F.lit(1 << 30)))).otherwise(case(name(s)))
            value = read(new, seq(s), qual(s))
        else:
            value = read(name(s), case(seq(s)), qual(s))
        columns[s] = value if where is None else F.when(where, value).otherwise(F.col(f"`{s}`"))
    return reads.with_df(reads.df.withColumns(columns))


def trim_at_tag(reads: Reads, label: str, direction: str, keep_tag: bool) -> Reads:
    """Cuts a read at a Location tag's only hit: what lies before (start) or behind (end), with or without the hit."""
    if label in reads.many:
        raise ConfigError(f"tag '{label}' may have several regions")
    first = F.get(tag(label), F.lit(0))
    begin, end = first["start"], first["start"] + first["len"]
    several = F.size(tag(label)) > 1
    from_start = direction == "start"
    place = (begin if keep_tag else end) if from_start else (end if keep_tag else begin)
    reads = reads.with_df(reads.df.withColumns({"_cut": place, "_here": first["segment"]}))
    cut, here = F.col("_cut"), F.col("_here")
    columns: dict[str, Column] = {}
    for k, s in enumerate(reads.segments):
        part = (lambda c: F.substring(c, cut + 1, F.lit(1 << 30))) if from_start else (lambda c: F.substring(c, F.lit(1), cut))
        checked = F.when(several, F.raise_error(F.lit(f"TrimAtTag: several hits of {label}"))).otherwise(part(seq(s)))
        columns[s] = F.when(here == k, read(name(s), checked, part(qual(s)))).otherwise(F.col(f"`{s}`"))
    for x in reads.locations():
        v = tag(x)
        if x == label and not keep_tag:
            value = F.transform(v, placeless)
        elif from_start:
            value = moved(v, here, lambda h: h["start"] < cut, lambda h: h["start"] - cut)
        else:
            value = moved(v, here, lambda h: h["start"] + h["len"] > cut, lambda h: h["start"])
        columns[f"t_{x}"] = F.when(here.isNotNull(), value).otherwise(v)
    return reads.with_df(reads.df.withColumns(columns).drop("_cut", "_here"))


def merge(reads: Reads, segment1: str, segment2: str, min_overlap: int, max_mismatch_rate: float, max_mismatch_count: int, no_overlap_strategy: str, reverse_complement_segment2: bool, concatenate_spacer: str = "", spacer_quality_char: int = 33, out_label: str | None = None) -> Reads:
    """Merges two overlapping segments into the first and empties the second; the tag says where that happened."""
    if min_overlap < 5 or not 0 <= max_mismatch_rate < 1:
        raise ConfigError("min_overlap must be at least 5 and max_mismatch_rate in [0, 1)")
    s2 = reverse_complement(seq(segment2)) if reverse_complement_segment2 else seq(segment2)
    q2 = F.reverse(qual(segment2)) if reverse_complement_segment2 else qual(segment2)
    df = reads.df.withColumn("_merged", merged(seq(segment1), qual(segment1), s2, q2, min_overlap, max_mismatch_rate, max_mismatch_count))
    done = F.col("_merged.seq").isNotNull()
    one, two = read(name(segment1), F.col("_merged.seq"), F.col("_merged.qual")), F.col(f"`{segment1}`")
    empty = read(name(segment2), F.lit(""), F.lit(""))
    if no_overlap_strategy == "concatenate":
        spacer = F.lit(chr(spacer_quality_char) * len(concatenate_spacer))
        two = read(name(segment1), F.concat(seq(segment1), F.lit(concatenate_spacer), s2), F.concat(qual(segment1), spacer, q2))
    new = {segment1: F.when(done, one).otherwise(two), segment2: empty if no_overlap_strategy == "concatenate" else F.when(done, empty).otherwise(F.col(f"`{segment2}`"))}
    out = reads.with_df(df.withColumns(new))
    out = out.with_tag(out_label, TagType.BOOL, done) if out_label else out
    return out.with_df(out.df.drop("_merged"))


def _on(segment: int):
    return lambda h: h["segment"] == segment


def _replaced(reads: Reads, label: str, letters, quality) -> dict[str, Column]:
    """Each segment with its located hits of a tag overwritten; hits are taken from the last to the first so that places hold."""
    columns = {}
    start = lambda h: h["start"]
    for k, s in enumerate(reads.segments):
        on_segment = _on(k)
        here = F.filter(tag(label), on_segment)
        ordered = F.array_sort(here, lambda a, b: start(b) - start(a))
        both = F.struct(seq(s).alias("seq"), qual(s).alias("qual"))

        def step(acc: Column, h: Column) -> Column:
            at, to = h["start"] + 1, h["start"] + h["len"] + 1
            put = lambda c, new: F.concat(F.substring(c, F.lit(1), h["start"]), new, F.substring(c, to, F.lit(1 << 30)))
            old = F.substring(acc["qual"], at, h["len"])
            return F.struct(put(acc["seq"], letters(h)).alias("seq"), put(acc["qual"], quality(h, old)).alias("qual"))

        new = F.aggregate(ordered, both, step)
        columns[s] = F.when(F.exists(tag(label), on_segment), read(name(s), new["seq"], new["qual"])).otherwise(F.col(f"`{s}`"))
    return columns


def store_tag_in_sequence(reads: Reads, label: str, ignore_missing: bool = False) -> Reads:
    """Writes hits' sequences back at their places.

    Equal lengths keep the qualities; else each new base has the rounded mean
    of those it replaces (`B` for none).  Where a length changes, all tags of
    the row lose their places on the segment.  A region without a place is an
    error unless ignore_missing.
    """
    mean = lambda q: F.when(F.length(q) == 0, F.lit("B")).otherwise(F.chr(F.round(F.aggregate(F.split(q, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)) / F.length(q)).cast("long")))
    quality = lambda h, old: F.when(F.length(h["sequence"]) == h["len"], old).otherwise(F.repeat(mean(old), F.length(h["sequence"])))
    columns = _replaced(reads, label, lambda h: h["sequence"], quality)
    if not ignore_missing:
        lost = F.coalesce(F.exists(tag(label), lambda h: h["start"].isNull()), F.lit(False))
        columns = {s: F.when(lost, F.raise_error(F.lit(f"StoreTagInSequence: a region of {label} has lost its place"))).otherwise(new) for s, new in columns.items()}
    grown = F.exists(tag(label), lambda h: h["start"].isNotNull() & (F.length(h["sequence"]) != h["len"]))
    for x in reads.locations():
        columns[f"t_{x}"] = F.when(F.coalesce(grown, F.lit(False)), F.transform(tag(x), placeless)).otherwise(tag(x))
    return reads.with_df(reads.df.withColumns(columns))


def replace_tag_with_letter(reads: Reads, label: str, letter: str) -> Reads:
    return reads.with_df(reads.df.withColumns(_replaced(reads, label, lambda h: F.repeat(F.lit(letter), h["len"]), lambda h, old: old)))


def number_text(value: Column) -> Column:
    """A number as comments have it: whole, or four decimals, or an exponent."""
    plain = F.format_string("%.4f", value)
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.4e", value), r"e\+?(-?)0*(\d)", "e$1$2"), r"\.?0+$", "")
    return F.when(value == F.floor(value), value.cast("long").cast("string")).when(F.abs(value).between(1e-3, 1e6), plain).otherwise(power)


def tag_text(reads: Reads, label: str, separator: str) -> Column:
    """A tag's value as comments have it; missing is empty."""
    kind, v = reads.tags[label], tag(label)
    text = {TagType.BOOL: v.cast("int").cast("string"), TagType.NUMERIC: number_text(v), TagType.STRING: v, TagType.LOCATION: joined_sequence(v, separator)}[kind]
    return F.coalesce(text, F.lit(""))


def with_comment(name_: Column, label: str, value: Column, separator: str, insert: str) -> Column:
    """A name with `<separator>label=value` put before its comment."""
    at = F.instr(name_, insert)
    put = F.concat(F.lit(f"{separator}{label}="), value)
    whole = F.when(at > 0, F.concat(F.substring(name_, F.lit(1), at - 1), put, F.substring(name_, at, F.lit(1 << 30)))).otherwise(F.concat(name_, put))
    bad = F.contains(value, F.lit(separator)) | F.contains(value, F.lit(insert))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"tag {label} holds a comment character: "), value))).otherwise(whole)


def _commented(reads: Reads, segment: str, label: str, value: Column, separator: str, insert: str) -> Reads:
    chosen = reads.segments if segment == "all" else (segment,)
    return reads.with_df(reads.df.withColumns({s: read(with_comment(name(s), label, value, separator, insert), seq(s), qual(s)) for s in chosen}))


def store_tag_in_comment(reads: Reads, label: str, segment: str = "all", comment_separator: str = "|", comment_insert_char: str = " ", region_separator: str = "_") -> Reads:
    return _commented(reads, segment, label, tag_text(reads, label, region_separator), comment_separator, comment_insert_char)


def places_text(reads: Reads, label: str) -> Column:
    """Places of a tag's hits as segment:start-end, comma-separated; hits without a place are left out."""
    names = F.array(*(F.lit(s) for s in reads.segments))
    placed = F.filter(tag(label), lambda h: h["segment"].isNotNull())
    text = F.transform(placed, lambda h: F.concat(F.get(names, h["segment"]), F.lit(":"), h["start"].cast("string"), F.lit("-"), (h["start"] + h["len"]).cast("string")))
    return F.coalesce(F.array_join(text, ","), F.lit(""))


def store_tag_location_in_comment(reads: Reads, label: str, segment: str = "all", comment_separator: str = "|", comment_insert_char: str = " ") -> Reads:
    return _commented(reads, segment, f"{label}_location", places_text(reads, label), comment_separator, comment_insert_char)
