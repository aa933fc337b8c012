"""Tags from other rows, files and tags; tags that are dropped, stored or counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import hamming, iupac_distance
from strandloom.model import ConfigError, Reads, SideOutput, TagType, joined_sequence, name, seq, tag
from strandloom.operators.calc import maybe_broadcast
from strandloom.operators.edits import places_text, tag_text, with_comment


def before(text: Column, character: str | None) -> Column:
    """A text up to the first of a character."""
    return text if not character else F.substring_index(text, character, 1)


def source_key(reads: Reads, source: str) -> Column:
    """What identifies a molecule: bases of a segment or of all joined, a tag's text, or a name before its comment; null if the tag is missing."""
    if source.startswith("tag:"):
        label = source[4:]
        kind = reads.tags.get(label)
        if kind is None:
            raise ConfigError(f"unknown tag '{label}'")
        return joined_sequence(tag(label), "\x7f") if kind is TagType.LOCATION else tag(label).cast("string")
    if source.startswith("name:"):
        chosen = reads.segments if source == "name:all" else (source[5:],)
        return F.concat(*(before(name(s), reads.comment) for s in chosen))
    return F.concat(*(seq(s) for s in (reads.segments if source == "all" else (source,))))


def duplicates(reads: Reads, source: str, out_label: str) -> Reads:
    """Whether a molecule with the same key came before, within its group; missing tags are no duplicates.

    The first of a key is an aggregation, combined before the shuffle, and
    joined back; a key that very many reads share is split by the join.
    """
    key = source_key(reads, source)
    by = reads.groups()
    df = reads.df.withColumn("_text", key)
    group = [F.coalesce(F.col(c), F.lit("\x00")).alias(f"_g{k}") for k, c in enumerate(by)]
    names = [f"_g{k}" for k in range(len(by))]
    df = df.select("*", *group)
    first = df.where("_text is not null").groupBy("_text", *names).agg(F.min("read_no").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = df.join(first, ["_text", *names], "left")
    out = reads.with_df(joined).with_tag(out_label, TagType.BOOL, F.coalesce(F.col("read_no") > F.col("_first"), F.lit(False)))
    return out.with_df(out.df.drop("_text", "_first", *names))


def other_file(reads: Reads, source: str, other: DataFrame, out_label: str, by_name: bool = False, other_end: str | None = None) -> Reads:
    """Whether the key is among the other file's sequences, or names up to a character.  An empty file is an error."""
    theirs = before(F.col("name"), other_end) if by_name else F.col("seq")
    keys = other.select(theirs.alias("_other")).distinct()
    if not keys.take(1):
        raise ConfigError("the other file has no reads")
    df = reads.df.withColumn("_key", source_key(reads, source))
    joined = df.join(maybe_broadcast(keys.withColumn("_there", F.lit(True))), F.col("_key") == F.col("_other"), "left")
    out = reads.with_df(joined).with_tag(out_label, TagType.BOOL, F.coalesce(F.col("_there"), F.lit(False)))
    return out.with_df(out.df.drop("_key", "_other", "_there"))


def concat_tags(reads: Reads, in_labels: list[str], out_label: str, separator: str = "", on_missing: str = "merge_present") -> Reads:
    """Hit lists one after another if all are Location tags, else texts joined."""
    if len(set(in_labels)) < 2 or len(set(in_labels)) != len(in_labels):
        raise ConfigError("at least two different tags are needed")
    kinds = {reads.tags[x] for x in in_labels}
    if not kinds <= {TagType.LOCATION, TagType.STRING}:
        raise ConfigError("only Location and String tags can be concatenated")
    all_there, any_there = F.lit(True), F.lit(False)
    for x in in_labels:
        all_there, any_there = all_there & tag(x).isNotNull(), any_there | tag(x).isNotNull()
    there = all_there if on_missing.lower().replace("_", "") == "setmissing" else any_there
    if kinds == {TagType.LOCATION}:
        none = F.array().cast(TagType.LOCATION.value)
        return reads.with_tag(out_label, TagType.LOCATION, F.when(there, F.concat(*(F.coalesce(tag(x), none) for x in in_labels))), many=True)
    texts = [joined_sequence(tag(x), separator) if reads.tags[x] is TagType.LOCATION else tag(x) for x in in_labels]
    return reads.with_tag(out_label, TagType.STRING, F.when(there, F.concat_ws(separator, *texts)))


def corrected(text: Column, barcodes: list[str], most: int, no_match: str) -> Column:
    """A text as the first barcode within the distance; null: to be removed."""
    plain = all(set(b.upper()) <= set("ACGT") for b in barcodes)
    value = F.when(text.isin(*barcodes), text)
    for b in barcodes:
        distance = hamming(text, b) if plain else iupac_distance(text, b)
        value = value.when((F.length(text) == len(b)) & (distance <= most), F.lit(b))
    return value.otherwise({"keep": text, "empty": F.lit(""), "remove": F.lit(None).cast("string")}[no_match.lower()])


def hamming_correct(reads: Reads, in_label: str, out_label: str, barcodes: list[str], max_hamming_distance: int, on_no_match: str) -> Reads:
    """Hits (or a text) corrected to barcodes; a tag without hits left is missing."""
    if max_hamming_distance < 1 or in_label == out_label:
        raise ConfigError("max_hamming_distance must be at least 1 and out_label another tag")
    kind = reads.tags[in_label]
    if kind is TagType.STRING:
        return reads.with_tag(out_label, TagType.STRING, corrected(tag(in_label), barcodes, max_hamming_distance, on_no_match))
    new = F.transform(tag(in_label), lambda h: F.struct(h["segment"].alias("segment"), h["start"].alias("start"), h["len"].alias("len"), corrected(h["sequence"], barcodes, max_hamming_distance, on_no_match).alias("sequence")))
    left = F.filter(new, lambda h: h["sequence"].isNotNull())
    return reads.with_tag(out_label, TagType.LOCATION, F.when(F.size(left) > 0, left), many=in_label in reads.many)


def forget(reads: Reads, labels: list[str] | None) -> Reads:
    """Without some tags, or without all."""
    gone = list(reads.tags) if labels is None else labels
    for x in gone:
        if x not in reads.tags:
            raise ConfigError(f"unknown tag '{x}'")
    return reads.with_df(reads.df.drop(*(f"t_{x}" for x in gone)), tags={k: v for k, v in reads.tags.items() if k not in gone}, many=reads.many - set(gone))


def table_text(reads: Reads, label: str, separator: str) -> Column:
    """A tag's value as tables have it: numbers in their shortest form."""
    if reads.tags[label] is not TagType.NUMERIC:
        return tag_text(reads, label, separator)
    v = tag(label)
    return F.coalesce(F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string")), F.lit(""))


def store_in_table(reads: Reads, infix: str = "tags", in_labels: list[str] | None = None, region_separator: str = "_") -> Reads:
    """A table of ReadName and tags: those listed, or all sorted by label."""
    labels = in_labels or sorted(reads.tags)
    if not labels:
        raise ConfigError("there are no tags to store")
    columns = [before(name(reads.segments[0]), reads.comment).alias("ReadName"), *(table_text(reads, x, region_separator).alias(x) for x in labels)]
    return reads.with_output(SideOutput("table", infix, reads.df.select("read_no", *reads.groups(), *columns), {"columns": ["ReadName", *labels]}))


def store_in_fastq(reads: Reads, label: str, comment_tags: list[str] | None = None, location_tags: list[str] | None = None, comment_separator: str = "|", comment_insert_char: str = " ", region_separator: str = "_") -> Reads:
    """A read of each molecule's hit sequence: the name of the hit's segment with comments, qualities of `~`."""
    v = tag(label)
    first = F.get(v, F.lit(0))
    text = joined_sequence(v, region_separator)
    names = F.array(*(name(s) for s in reads.segments))
    named = F.coalesce(F.get(names, first["segment"]), name(reads.segments[0]))
    for x in comment_tags or ():
        named = with_comment(named, x, tag_text(reads, x, region_separator), comment_separator, comment_insert_char)
    for x in location_tags if location_tags is not None else [label]:
        named = with_comment(named, f"{x}_location", places_text(reads, x), comment_separator, comment_insert_char)
    rows = reads.df.where(v.isNotNull() & (F.length(text) > 0)).select("read_no", *reads.groups(), named.alias("name"), text.alias("seq"), F.repeat(F.lit("~"), F.length(text)).alias("qual"))
    return reads.with_output(SideOutput("tag reads", label, rows))


def quantified(reads: Reads, label: str, region_separator: str = "_") -> DataFrame:
    """How often each text of a Location tag occurs, per group."""
    if reads.tags.get(label) is not TagType.LOCATION:
        raise ConfigError(f"tag '{label}' is not a Location tag")
    key = joined_sequence(tag(label), region_separator)
    return reads.df.where(tag(label).isNotNull()).groupBy(*reads.groups(), key.alias("key")).agg(F.count("*").alias("count"))


def quantify(reads: Reads, label: str, infix: str, region_separator: str = "_") -> Reads:
    ordered = quantified(reads, label, region_separator).orderBy(*reads.groups(), F.desc("count"), F.lower("key"))
    return reads.with_output(SideOutput("counts", infix, ordered))

