"""Reports: counts and distributions of the reads at one point of a pipeline, each an aggregation that is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.model import Reads, SideOutput, TagType, joined_sequence, qual, seq, tag


def molecule_count(reads: Reads) -> DataFrame:
    return reads.df.groupBy(*reads.groups()).agg(F.count("*").alias("molecule_count"))


def _segments(reads: Reads, *columns) -> DataFrame:
    """A row for each segment of each molecule: segment, groups and columns made of the segment's name."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), *(c(s) for c in columns)) for s in reads.segments)))
    return reads.df.select(*reads.groups(), each.alias("_s")).select(*reads.groups(), "_s.*")


def length_distribution(reads: Reads) -> DataFrame:
    rows = _segments(reads, lambda s: F.length(seq(s)).alias("length"))
    return rows.groupBy(*reads.groups(), "segment", "length").agg(F.count("*").alias("count"))


def duplicate_count_per_read(reads: Reads) -> DataFrame:
    """Per segment, reads whose sequence was seen before: all but one of each."""
    rows = _segments(reads, lambda s: seq(s).alias("seq"))
    each = rows.groupBy(*reads.groups(), "segment", "seq").agg(F.count("*").alias("n"))
    return each.groupBy(*reads.groups(), "segment").agg(F.sum(F.col("n") - 1).alias("duplicate_count"))


def duplicate_count_per_fragment(reads: Reads) -> DataFrame:
    each = reads.df.groupBy(*reads.groups(), *(seq(s).alias(f"_{k}") for k, s in enumerate(reads.segments))).agg(F.count("*").alias("n"))
    return each.groupBy(*reads.groups()).agg(F.sum(F.col("n") - 1).alias("fragment_duplicate_count"))


#: Quality bytes from which a base counts as q20 and as q30.
Q20, Q30 = 53, 63


def base_totals(reads: Reads) -> DataFrame:
    """Per segment: total, q20, q30 and GC bases."""
    letters = "".join(map(chr, range(33, 127)))
    above = lambda q, least: F.length(q) - F.length(F.translate(q, letters[least - 33 :], ""))
    gc = lambda s: F.length(seq(s)) - F.length(F.translate(seq(s), "GCgc", ""))
    rows = _segments(reads, lambda s: F.length(seq(s)).alias("n"), lambda s: above(qual(s), Q20).alias("q20"), lambda s: above(qual(s), Q30).alias("q30"), lambda s: gc(s).alias("gc"))
    return rows.groupBy(*reads.groups(), "segment").agg(F.sum("n").alias("total_bases"), F.sum("q20").alias("q20_bases"), F.sum("q30").alias("q30_bases"), F.sum("gc").alias("gc_bases"))


def base_positions(reads: Reads) -> DataFrame:
    """Per segment and place in the read: counts of a, c, g, t and others, and the sum of error probabilities.

    Letters are counted by place and quality first, so that each partial
    aggregation holds a few thousand groups, whatever the number of reads.
    """
    rows = _segments(reads, lambda s: seq(s).alias("seq"), lambda s: qual(s).alias("qual"))
    places = rows.where(F.length("seq") > 0).select(*reads.groups(), "segment", "seq", "qual", F.posexplode(F.sequence(F.lit(1), F.length("seq"))).alias("position", "_p"))
    letters = places.select(*reads.groups(), "segment", "position", F.upper(F.substring("seq", F.col("_p"), F.lit(1))).alias("b"), F.ascii(F.substring("qual", F.col("_p"), F.lit(1))).alias("q"))
    counted = letters.groupBy(*reads.groups(), "segment", "position", "b", "q").agg(F.count("*").alias("n"))
    one = lambda x: F.sum(F.when(F.col("b") == x, F.col("n")).otherwise(0)).alias(x.lower())
    other = F.sum(F.when(F.col("b").isin("A", "C", "G", "T"), 0).otherwise(F.col("n"))).alias("n")
    error = F.sum(F.col("n") * F.pow(F.lit(10.0), (F.lit(33) - F.col("q")) / 10.0)).alias("expected_errors")
    return counted.groupBy(*reads.groups(), "segment", "position").agg(one("A"), one("C"), one("G"), one("T"), other, error)


def count_oligos(reads: Reads, oligos: list[str], segment: str = "all") -> DataFrame:
    """Reads that contain each oligo; with `all`, each segment counts by itself."""
    chosen = reads.segments if segment == "all" else (segment,)
    sums = [sum((F.sum(F.contains(seq(s), F.lit(o)).cast("long")) for s in chosen), F.lit(0)).alias(f"c{k}") for k, o in enumerate(oligos)]
    wide = reads.df.groupBy(*reads.groups()).agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("oligo"), F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("long").alias("count")) for k, o in enumerate(oligos))))
    return wide.select(*reads.groups(), each.alias("_o")).select(*reads.groups(), "_o.*")


def tag_histogram(reads: Reads, label: str) -> DataFrame:
    """How often a tag has each value: texts (missing: empty), rounded numbers (missing left out), true and false."""
    kind, v = reads.tags[label], tag(label)
    df = reads.df
    if kind is TagType.NUMERIC:
        df = df.where(v.isNotNull())
        value: Column = F.round(v).cast("long").cast("string")
    elif kind is TagType.BOOL:
        value = F.coalesce(v, F.lit(False)).cast("string")
    else:
        value = F.coalesce(joined_sequence(v, "_") if kind is TagType.LOCATION else v, F.lit(""))
    return df.groupBy(*reads.groups(), value.alias("value")).agg(F.count("*").alias("count"))


#: The parts of a report in the order in which they stand in it, and the options that ask for them.
PARTS = ("count", "length_distribution", "duplicate_count_per_read", "duplicate_count_per_fragment", "base_statistics")


def report(reads: Reads, name: str, parts: set[str], oligos: list[str] = (), oligo_segment: str = "all", histograms: list[str] = ()) -> Reads:
    makers = {"count": [molecule_count], "length_distribution": [length_distribution], "duplicate_count_per_read": [duplicate_count_per_read], "duplicate_count_per_fragment": [duplicate_count_per_fragment], "base_statistics": [base_totals, base_positions]}
    for part in PARTS:
        for make in makers[part] if part in parts else ():
            reads = reads.with_output(SideOutput("report", name, make(reads), {"part": make.__name__, "groups": reads.groups()}))
    if oligos:
        reads = reads.with_output(SideOutput("report", name, count_oligos(reads, list(oligos), oligo_segment), {"part": "count_oligos", "groups": reads.groups()}))
    for label in histograms:
        reads = reads.with_output(SideOutput("report", name, tag_histogram(reads, label), {"part": "histogram", "tag": label, "groups": reads.groups()}))
    return reads


def inspect(reads: Reads, n: int, infix: str, segment: str = "all") -> Reads:
    """The first n molecules, as they are here."""
    first = reads.df.where(F.col("read_no") < n) if reads.dense else reads.df.orderBy("read_no").limit(n)
    return reads.with_output(SideOutput("inspect", infix, first, {"segments": reads.segments if segment == "all" else (segment,), "demux": bool(reads.demux), "interleaved": segment == "all"}))


def progress(reads: Reads, n: int = 1_000_000, infix: str | None = None) -> Reads:
    """The number of molecules here and the whole steps of n among them, written at the end of the run."""
    counted = reads.df.agg(F.count("*").alias("molecules"), F.floor(F.count("*") / n).alias("steps"))
    return reads.with_output(SideOutput("progress", infix or "", counted, {"n": n}))


def assembled(parts: list[tuple[dict, list]]) -> dict:
    """The JSON of one report from (details, rows) of its parts; groups stand above what is counted in them."""
    out: dict = {}
    for details, rows in parts:
        for row in rows:
            r = row.asDict()
            group = r.pop("_demux", None)
            if details["groups"] and group is None:
                continue
            part = details["part"]
            if part == "count_oligos" or part == "histogram":
                at = out.setdefault("count_oligos" if part == "count_oligos" else "histogram", {})
                at = at.setdefault(details["tag"], {}) if part == "histogram" else at
                at = at.setdefault(group, {}) if details["groups"] else at
                at[r.get("oligo", r.get("value"))] = r["count"]
                continue
            at = out.setdefault(group, {}) if details["groups"] else out
            segment = r.pop("segment", None)
            at = at.setdefault(segment, {}) if segment else at
            if part == "length_distribution":
                counts = at.setdefault("length_distribution", [])
                counts += [0] * (r["length"] + 1 - len(counts))
                counts[r["length"]] = r["count"]
            elif part == "base_totals":
                at.setdefault("base_statistics", {}).update(r)
            elif part == "base_positions":
                stats = at.setdefault("base_statistics", {})
                curve = stats.setdefault("expected_errors_from_quality_curve", [])
                curves = {"": curve} | {x: stats.setdefault("per_position_counts", {}).setdefault(x, []) for x in "acgtn"}
                for x, c in curves.items():
                    c += [0] * (r["position"] + 1 - len(c))
                    c[r["position"]] = r[x] if x else r["expected_errors"]
            else:
                at.update(r)
    return out
