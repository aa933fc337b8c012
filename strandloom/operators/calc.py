"""Numeric tags, and expressions over tags."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import reverse_complement
from strandloom.functions.expression import Expression
from strandloom.model import ConfigError, Reads, TagType, joined_sequence, qual, seq, tag

#: Side tables of at most this many rows may be broadcast.
MOST_BROADCAST_ROWS = 2_000_000


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; a larger side is shuffled."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS else df


def over(reads: Reads, segment: str, value) -> Column:
    """A per-segment number, summed if the segment is `all`."""
    return reduce(add, [value(s) for s in (reads.segments if segment == "all" else (segment,))])


def _number(reads: Reads, label: str, value: Column) -> Reads:
    return reads.with_tag(label, TagType.NUMERIC, value.cast("double"))


def length(reads: Reads, segment: str, out_label: str) -> Reads:
    return _number(reads, out_label, over(reads, segment, lambda s: F.length(seq(s))))


def _count(text: Column, letters: str) -> Column:
    """How many letters of a text, in either case, are among some."""
    both = "".join(sorted(set(letters.upper() + letters.lower())))
    return F.length(text) - F.length(F.translate(text, both, ""))


def base_content(reads: Reads, segment: str, bases_to_count: str, out_label: str, bases_to_ignore: str = "", relative: bool = True) -> Reads:
    """Bases of some kind: their count, or their share in percent of those that aren't ignored."""
    if bases_to_ignore and not relative:
        raise ConfigError("bases_to_ignore is for relative counts")
    ignored = set(bases_to_ignore.upper())
    counted = over(reads, segment, lambda s: _count(seq(s), "".join(set(bases_to_count.upper()) - ignored)))
    if not relative:
        return _number(reads, out_label, counted)
    considered = over(reads, segment, lambda s: F.length(seq(s)) - (_count(seq(s), bases_to_ignore) if bases_to_ignore else F.lit(0)))
    return _number(reads, out_label, F.when(considered > 0, 100.0 * counted / considered).otherwise(0.0))


def gc_content(reads: Reads, segment: str, out_label: str) -> Reads:
    return base_content(reads, segment, "GC", out_label, "N", True)


def n_count(reads: Reads, segment: str, out_label: str) -> Reads:
    return base_content(reads, segment, "N", out_label, "", False)


def complexity(reads: Reads, segment: str, out_label: str) -> Reads:
    """The share of neighbouring bases that differ; 0 for reads of at most one base."""
    changes = over(reads, segment, lambda s: F.greatest(F.length(F.regexp_replace(seq(s), r"(?s)(.)\1+", "$1")) - 1, F.lit(0)))
    places = over(reads, segment, lambda s: F.greatest(F.length(seq(s)) - 1, F.lit(0)))
    return _number(reads, out_label, F.when(places > 0, changes / places).otherwise(0.0))


#: Names of comparisons of quality bytes.
COMPARISONS = {">": (">", "gt", "above", "worse"), "<": ("<", "lt", "below", "better"), ">=": (">=", "gte", "above_or_equal", "wbove_or_equal", "worse_or_equal"), "<=": ("<=", "lte", "below_or_equal", "better_or_equal")}


def qualified_bases(reads: Reads, segment: str, threshold: int, operator: str, out_label: str) -> Reads:
    """Quality bytes that compare with a threshold byte."""
    op = next((k for k, names in COMPARISONS.items() if operator.lower() in names), None)
    if op is None:
        raise ConfigError(f"unknown operator '{operator}'")
    test = {">": lambda b: b > threshold, "<": lambda b: b < threshold, ">=": lambda b: b >= threshold, "<=": lambda b: b <= threshold}[op]
    others = "".join(chr(b) for b in range(33, 127) if not test(b))
    return _number(reads, out_label, over(reads, segment, lambda s: F.length(F.translate(qual(s), others, "") if others else qual(s))))


def error_of(q: Column) -> Column:
    """Probability of an error from a quality letter."""
    return F.pow(F.lit(10.0), (F.lit(33) - F.ascii(q)) / 10.0)


def expected_error(reads: Reads, segment: str, aggregate: str, out_label: str) -> Reads:
    """Sum or maximum of the error probabilities; bytes outside 33..126 are an error."""

    def one(s: str) -> Column:
        letters = F.split(qual(s), "")
        fine = F.regexp_like(qual(s), F.lit(r"^[\x21-\x7e]*$"))
        if aggregate.lower() == "max":
            worst = F.array_min(F.transform(F.filter(letters, lambda c: c != ""), F.ascii))
            value = F.coalesce(F.pow(F.lit(10.0), (F.lit(33) - worst) / 10.0), F.lit(0.0))
        else:
            # a count for each quality that occurs would need a loop as well; one pass over the letters it is
            value = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a + error_of(c))
        return F.when(fine, value).otherwise(F.raise_error(F.concat(F.lit("quality outside 33..126: "), qual(s))).cast("double"))

    values = [one(s) for s in (reads.segments if segment == "all" else (segment,))]
    if aggregate.lower() == "max":
        return _number(reads, out_label, F.greatest(*values) if len(values) > 1 else values[0])
    return _number(reads, out_label, reduce(add, values))


def windows(text: Column, k: int) -> Column:
    """All k-mers of a text, in order; none of a shorter one."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda p: F.substring(text, p, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_table(side: DataFrame, k: int, count_reverse_complement: bool, min_count: int) -> DataFrame:
    """The k-mers (kmer) of sequences (seq) that occur at least min_count times, with reverse complements if wanted."""
    upper = F.upper("seq")
    found = side.select(F.explode(windows(upper, k)).alias("kmer")).where(F.regexp_like("kmer", F.lit("^[ACGT]+$")))
    counted = found.groupBy("kmer").count()
    if count_reverse_complement:
        both = counted.unionAll(counted.select(reverse_complement(F.col("kmer")).alias("kmer"), "count"))
        counted = both.groupBy("kmer").agg(F.sum("count").alias("count"))
    return counted.where(F.col("count") >= min_count).select("kmer")


def kmers(reads: Reads, segment: str, side: DataFrame, k: int, count_reverse_complement: bool, out_label: str, min_count: int = 1) -> Reads:
    """Places of a read whose k-mer the side table has."""
    known = maybe_broadcast(kmer_table(side, k, count_reverse_complement, min_count))
    mine = F.flatten(F.array(*(windows(F.upper(seq(s)), k) for s in (reads.segments if segment == "all" else (segment,)))))
    counts = reads.df.select("read_no", F.explode(mine).alias("kmer")).join(known, "kmer").groupBy("read_no").agg(F.count("*").alias("_n"))
    out = reads.with_df(reads.df.join(counts, "read_no", "left"))
    out = _number(out, out_label, F.coalesce(F.col("_n"), F.lit(0)))
    return out.with_df(out.df.drop("_n"))


def hits_length(hits: Column) -> Column:
    """Bases that hits cover; a hit without a place counts its sequence."""
    return F.aggregate(hits, F.lit(0), lambda a, h: a + F.coalesce(h["len"], F.length(h["sequence"])))


def regions_to_length(reads: Reads, in_label: str, out_label: str) -> Reads:
    return _number(reads, out_label, F.coalesce(hits_length(tag(in_label)), F.lit(0)))


#: Numbers closer to zero than this are false.
EPSILON = 2.0**-52


def eval_expression(reads: Reads, expression: str, result_type: str, out_label: str) -> Reads:
    """An expression over tags, len_<segment>, len_<tag> and read_no, the index among the reads that reach this point.

    Bool tags are 1 or 0; String and Location tags are 1 if they are there.
    """
    parsed = Expression(expression)
    counted = "read_no" in parsed.names
    reads = reads.running_index() if counted else reads
    variables: dict[str, Column] = {}
    for n in parsed.names:
        if n == "read_no":
            variables[n] = F.col("_index").cast("double")
        elif n.startswith("len_") and n[4:] in reads.segments:
            variables[n] = F.length(seq(n[4:])).cast("double")
        elif n.startswith("len_") and n[4:] in reads.tags:
            kind = reads.tags[n[4:]]
            if kind in (TagType.NUMERIC, TagType.BOOL):
                raise ConfigError(f"tag '{n[4:]}' has no length")
            text = joined_sequence(tag(n[4:])) if kind is TagType.LOCATION else tag(n[4:])
            variables[n] = F.coalesce(F.length(text), F.lit(0)).cast("double")
        elif n in reads.tags:
            kind = reads.tags[n]
            there = tag(n).isNotNull().cast("double")
            variables[n] = there if kind in (TagType.STRING, TagType.LOCATION) else F.coalesce(tag(n).cast("double"), F.lit(0.0))
        else:
            raise ConfigError(f"unknown variable '{n}'")
    value = parsed.column(variables)
    out = reads.with_tag(out_label, TagType.BOOL, F.abs(value) > EPSILON) if result_type.lower() == "bool" else _number(reads, out_label, value)
    return out.with_df(out.df.drop("_index")) if counted else out
