"""The data model: molecules are rows, segments are struct columns, tags are typed columns.

A frame of reads has the columns

    read_no          long, the order of the input, unique
    <segment>        struct<name, seq, qual>, one column a segment
    t_<label>        one column a tag: double, boolean, string or an array of hits
    _demux           string, after Demultiplex; null: dropped by the sinks

A hit is struct<segment, start, len, sequence>; segment, start and len are null
together when an edit has made the place meaningless.  A tag that a molecule
doesn't have is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = "struct<segment:int,start:int,len:int,sequence:string>"
HITS = f"array<{HIT}>"
#: Reads whose ranks are counted together; see ordered_rank.
RANK_BLOCK = 1_000_000


class TagType(Enum):
    LOCATION = HITS
    STRING = "string"
    NUMERIC = "double"
    BOOL = "boolean"


class ConfigError(ValueError):
    """A pipeline that can't run as it is written."""


@dataclass(frozen=True)
class SideOutput:
    """A result beside the reads: a frame made at one point of the pipeline, and how it is to be written."""

    kind: str
    name: str
    df: DataFrame
    details: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Reads:
    """A frame of reads and what is known about it before any data is touched."""

    df: DataFrame
    segments: tuple[str, ...]
    tags: dict[str, TagType] = field(default_factory=dict)
    many: frozenset[str] = frozenset()  # Location tags that may have several hits
    demux: tuple[str, ...] = ()  # labels of the Demultiplex steps so far
    dense: bool = True  # read_no still counts the rows that are left
    comment: str = " "  # splits a name from its comment
    outputs: tuple[SideOutput, ...] = ()

    def with_df(self, df: DataFrame, **changes) -> Reads:
        return replace(self, df=df, **changes)

    def with_tag(self, label: str, kind: TagType, value: Column, many: bool = False) -> Reads:
        if label in self.tags:
            raise ConfigError(f"tag '{label}' is declared twice")
        tags = self.tags | {label: kind}
        return self.with_df(self.df.withColumn(f"t_{label}", value), tags=tags, many=self.many | {label} if many else self.many)

    def with_output(self, output: SideOutput) -> Reads:
        return replace(self, outputs=(*self.outputs, output))

    def index(self, segment: str) -> int:
        return self.segments.index(segment)

    def locations(self) -> list[str]:
        return [x for x, kind in self.tags.items() if kind is TagType.LOCATION]

    def groups(self) -> list[str]:
        return ["_demux"] if self.demux else []

    def running_index(self) -> Reads:
        """With a column _index: 0, 1, ... over the reads that reach this point."""
        if self.dense:
            return self.with_df(self.df.withColumn("_index", F.col("read_no")))
        ranked = ordered_rank(self.df, [], "_index")
        return self.with_df(ranked.withColumn("_index", F.col("_index") - 1))


def seq(segment: str) -> Column:
    return F.col(f"`{segment}`.seq")


def qual(segment: str) -> Column:
    return F.col(f"`{segment}`.qual")


def name(segment: str) -> Column:
    return F.col(f"`{segment}`.name")


def tag(label: str) -> Column:
    return F.col(f"t_{label}")


def read(name_: Column, seq_: Column, qual_: Column) -> Column:
    return F.struct(name_.alias("name"), seq_.alias("seq"), qual_.alias("qual"))


def joined_sequence(hits: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(hits, lambda h: h["sequence"]), separator)


def truth(reads: Reads, label: str) -> Column:
    """Whether a molecule has the tag: Bool tags by value, Location and String tags by being there."""
    kind = reads.tags[label]
    if kind is TagType.NUMERIC:
        raise ConfigError(f"tag '{label}' is numeric and has no truth")
    return F.coalesce(tag(label), F.lit(False)) if kind is TagType.BOOL else tag(label).isNotNull()


def insisting(reads: Reads, fine: Column, message: Column) -> Reads:
    """The frame, where a row that isn't fine (null: not fine) raises the message.

    The condition counts as not deterministic, so that it stays where it stands:
    it is neither dropped with columns that nobody reads nor moved before the
    steps that remove rows.
    """
    passed = F.when(fine, F.spark_partition_id() >= 0).otherwise(F.raise_error(message).cast("boolean"))
    return reads.with_df(reads.df.where(passed))


def ordered_rank(df: DataFrame, by: list[str], name_: str) -> DataFrame:
    """df with the rank from 1, by read_no, within the columns `by` (null is a value).

    Counts of blocks of read_no give where each block's ranks start, so ranks
    are found block by block, and no task gets a whole group.
    """
    keys = [F.coalesce(F.col(c), F.lit("\x00")).alias(f"_k{k}") for k, c in enumerate(by)]
    names = [f"_k{k}" for k in range(len(by))]
    cut = df.select("*", *keys, F.floor(F.col("read_no") / RANK_BLOCK).alias("_block"))
    counts = cut.groupBy(*names, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*names, "_block").orderBy("read_no"))
    ranked = cut.withColumn("_within", within).join(starts, [*names, "_block"])
    return ranked.withColumn(name_, F.col("_before") + F.col("_within")).drop(*names, "_block", "_before", "_within")
