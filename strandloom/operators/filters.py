"""Selections of molecules: by tags, by order, by chance that depends on read_no and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strandloom.model import ConfigError, Reads, TagType, ordered_rank, seq, tag, truth


def kept(reads: Reads, fits: Column, keep_or_remove: str = "keep") -> Reads:
    if keep_or_remove.lower() not in ("keep", "remove"):
        raise ConfigError("keep_or_remove is keep or remove")
    return reads.with_df(reads.df.where(fits if keep_or_remove.lower() == "keep" else ~fits), dense=False)


def by_tag(reads: Reads, in_label: str, keep_or_remove: str) -> Reads:
    return kept(reads, truth(reads, in_label), keep_or_remove)


def by_numeric_tag(reads: Reads, in_label: str, keep_or_remove: str, min_value: float | None = None, max_value: float | None = None) -> Reads:
    """min_value <= tag < max_value; a missing number doesn't fit."""
    if min_value is None and max_value is None:
        raise ConfigError("min_value or max_value is needed")
    if reads.tags.get(in_label) is not TagType.NUMERIC:
        raise ConfigError(f"tag '{in_label}' is not numeric")
    fits = tag(in_label).isNotNull()
    fits = fits & (tag(in_label) >= min_value) if min_value is not None else fits
    fits = fits & (tag(in_label) < max_value) if max_value is not None else fits
    return kept(reads, F.coalesce(fits, F.lit(False)), keep_or_remove)


def empty(reads: Reads, segment: str) -> Reads:
    """Removes molecules whose segment, or all whose segments, are empty."""
    fits = F.lit(False)
    for s in reads.segments if segment == "all" else (segment,):
        fits = fits | (F.length(seq(s)) > 0)
    return kept(reads, fits)


def head(reads: Reads, n: int) -> Reads:
    """The first n molecules, of each group after Demultiplex."""
    if not reads.demux and reads.dense:
        return reads.with_df(reads.df.where(F.col("read_no") < n))
    ranked = ordered_rank(reads.df, reads.groups(), "_rank")
    return reads.with_df(ranked.where(F.col("_rank") <= n).drop("_rank"), dense=False)


def skip(reads: Reads, n: int) -> Reads:
    """All but the first n molecules, of each group after Demultiplex."""
    if not reads.demux and reads.dense:
        return reads.with_df(reads.df.where(F.col("read_no") >= n), dense=False)
    ranked = ordered_rank(reads.df, reads.groups(), "_rank")
    return reads.with_df(ranked.where(F.col("_rank") > n).drop("_rank"), dense=False)


def chance(seed: int) -> Column:
    """A number in [0, 1) for each molecule: 52 bits of the MD5 of seed and read_no."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("read_no").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(reads: Reads, p: float, seed: int) -> Reads:
    if not 0 < p < 1:
        raise ConfigError("p must be between 0 and 1")
    return kept(reads, chance(seed) < p)


def reservoir_sample(reads: Reads, n: int, seed: int) -> Reads:
    """n molecules of each group, all equally likely: those with the least chances.

    A group's n are found task by task first; only those are brought together.
    """
    if n < 1:
        raise ConfigError("n must be positive")
    df = reads.df.withColumn("_chance", chance(seed))
    if not reads.demux:
        return reads.with_df(df.orderBy("_chance", "read_no").limit(n).drop("_chance"), dense=False)
    lots = 64
    group = F.coalesce("_demux", F.lit("\x00"))
    dealt = df.withColumn("_lot", F.pmod(F.col("read_no"), F.lit(lots)))
    first = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_lot").orderBy("_chance", "read_no"))).where(F.col("_r") <= n)
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_chance", "read_no"))).where(F.col("_r") <= n)
    return reads.with_df(best.drop("_r", "_lot", "_chance"), dense=False)
