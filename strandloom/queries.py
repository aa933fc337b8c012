"""One query for each operator, over reads derived from `lineitem`, and the same in DuckDB's SQL.

A read's name has the order, the line and the supplier; bases and qualities are
letters made of MD5 sums, of 18 to 30 places by the line's number.  Queries
that don't depend on order number the reads as they come, without a shuffle;
the others number them by their keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.model import Reads, joined_sequence, name, qual, seq, tag
from strandloom.operators import calc, demultiplex, edits, extract, filters, reports, tags, validate
from strandloom.operators.extract import Region

HEX, BASES, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGN", "#+5:<?ABCDEFGHII"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


#: Reads that a bench has stored, by (folder, ordered, paired).
STORED: dict[tuple[str, bool, bool], str] = {}


def numbered(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """lines with _number from 0 in the order of their keys: blocks of order keys are counted first, then ranked block by block."""
    cut = lines.withColumn("_block", F.floor(F.col("l_orderkey") / block))
    counts = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_block", before.alias("_before"))  # a row a block
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*ORDER)) - 1
    return cut.withColumn("_within", within).join(starts, "_block").withColumn("_number", F.col("_before") + F.col("_within"))


def reads(spark: SparkSession, sf_dir: str, ordered: bool = False, paired: bool = False) -> Reads:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if (folder := STORED.get((sf_dir, ordered, paired))) is not None:
        df = spark.read.parquet(folder)
        return Reads(df, tuple(c for c in df.columns if c != "read_no"), dense=ordered)
    lines = numbered(lines) if ordered else lines
    number = F.col("_number") if ordered else F.monotonically_increasing_id()
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    size = 16 + 2 * F.col("l_linenumber")

    def text(salt: str, letters: str):
        return F.substring(F.translate(F.md5(F.concat(F.lit(salt), key)), HEX, letters), F.lit(1), size)

    title = F.concat(F.lit("r"), key, F.lit(" c"), F.col("l_suppkey").cast("string"))
    struct = lambda s, q: F.struct(title.alias("name"), text(s, BASES).alias("seq"), text(q, QUALITIES).alias("qual"))
    segments = {"read1": struct("s", "q")} | ({"read2": struct("s2", "q2")} if paired else {})
    return Reads(lines.select(number.cast("long").alias("read_no"), *(v.alias(k) for k, v in segments.items())), tuple(segments), dense=ordered)


def _text(salt: str, letters: str) -> str:
    return f"substr(translate(md5('{salt}' || l_orderkey || '-' || l_linenumber), '{HEX}', '{letters}'), 1, 16 + 2 * l_linenumber)"


#: The reads in SQL.
BASE = f"""with reads as (select row_number() over (order by {", ".join(ORDER)}) - 1 as read_no,
    'r' || l_orderkey || '-' || l_linenumber || ' c' || l_suppkey as name,
    {_text("s", BASES)} as seq, {_text("q", QUALITIES)} as qual, {_text("s2", BASES)} as seq2, {_text("q2", QUALITIES)} as qual2 from lineitem)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, as_hits: bool = False, **how):
    """Registers a function of reads under its name; sql: what follows the reads in the oracle's text; as_hits: it gives places as `located` does."""

    def put(make: Callable[[Reads], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(reads(spark, sf_dir, **how))
        if sql is not None:
            text = f"{BASE}{sql}" if sql.startswith(",") else f"{BASE} {sql}"
            hits = "select name, cast(coalesce(start, -1) as bigint) as start, cast(coalesce(len, -1) as bigint) as len, coalesce(sequence, '') as sequence from"
            ORACLE[make.__name__] = f"{hits} ({text})" if as_hits else text
        return make

    return put


def whole(r: Reads, s: str = "read1") -> DataFrame:
    return r.df.select(name(s).alias("name"), seq(s).alias("seq"), qual(s).alias("qual"))


def located(r: Reads, label: str) -> DataFrame:
    """name, and start, len and sequence of a tag's first hit; -1 and empty without one."""
    h = F.get(tag(label), F.lit(0))
    least = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return r.df.select(name("read1").alias("name"), least(h["start"]).alias("start"), least(h["len"]).alias("len"), F.coalesce(h["sequence"], F.lit("")).alias("sequence"))


def valued(r: Reads, label: str, digits: int | None = None) -> DataFrame:
    v = tag(label) if digits is None else F.round(tag(label), digits)
    return r.df.select(name("read1").alias("name"), v.alias("value"))


# edits


@query("select name, substr(seq, 4) as seq, substr(qual, 4) as qual from reads")
def cut_start(r):
    return whole(edits.cut_start(r, "read1", 3))


@query("select name, substr(seq, 1, length(seq) - 4) as seq, substr(qual, 1, length(qual) - 4) as qual from reads")
def cut_end(r):
    return whole(edits.cut_end(r, "read1", 4))


@query("select name, substr(seq, 1, 20) as seq, substr(qual, 1, 20) as qual from reads")
def truncate(r):
    return whole(edits.truncate(r, "read1", 20))


@query("select name, 'ACG' || seq as seq, 'IFI' || qual as qual from reads")
def prefix(r):
    return whole(edits.prefix(r, "read1", "ACG", "IFI"))


@query("select name, seq || 'TTN' as seq, qual || '##I' as qual from reads")
def postfix(r):
    return whole(edits.postfix(r, "read1", "TTN", "##I"))


@query("select name, reverse(translate(seq, 'ACGT', 'TGCA')) as seq, reverse(qual) as qual from reads")
def reverse_complement(r):
    return whole(edits.reverse_complement_step(r, "read1"))


@query("select name, seq, translate(qual, '#+5:<?ABCDEFGHI', 'BJTY[^`abcdefgh') as qual from reads")
def convert_quality(r):
    return whole(edits.convert_quality(r, "sanger", "illumina13"))


@query(r"select regexp_replace(name, 'r(\d+)-', read_no || '_\1_') as name, seq, qual from reads", ordered=True)
def rename(r):
    return whole(edits.rename(r, r"r(\d+)-", "{{READ_INDEX}}_$1_"))


@query("select name, seq2 as seq, qual2 as qual from reads", paired=True)
def swap(r):
    return whole(edits.swap(r, "read1", "read2"))


@query("select name, case when 100.0 * (length(seq) - length(translate(seq, 'GC', ''))) / length(translate(seq, 'N', '')) >= 50 then lower(seq) else seq end as seq, qual from reads")
def lowercase_if(r):
    r = calc.eval_expression(calc.gc_content(r, "read1", "gc"), "gc >= 50", "bool", "rich")
    return whole(edits.change_case(r, "read1", False, "rich"))


@query("select upper(split_part(name, ' ', 1)) || ' ' || split_part(name, ' ', 2) as name, seq, qual from reads")
def uppercase_name(r):
    return whole(edits.change_case(r, "name:read1", True))


@query("select name, case when strpos(seq, 'ACG') > 0 then substr(seq, 1, strpos(seq, 'ACG') - 1) else seq end as seq, case when strpos(seq, 'ACG') > 0 then substr(qual, 1, strpos(seq, 'ACG') - 1) else qual end as qual from reads")
def trim_at_tag(r):
    return whole(edits.trim_at_tag(extract.iupac(r, "read1", ["ACG"], "anywhere", 0, "hit"), "hit", "end", False))


@query("select name, substr(seq, 1, 2) || lower(substr(seq, 3, 4)) || substr(seq, 7) as seq, qual from reads")
def store_tag_in_sequence(r):
    r = extract.regions(r, [Region("read1", 2, 4)], "part")
    return whole(edits.store_tag_in_sequence(edits.change_case(r, "tag:part", False), "part"))


@query("select name, substr(seq, 1, length(rtrim(qual, '#+5:<'))) || repeat('N', length(seq) - length(rtrim(qual, '#+5:<'))) as seq, qual from reads")
def replace_tag_with_letter(r):
    return whole(edits.replace_tag_with_letter(extract.low_quality_end(r, "read1", ord("?"), "low"), "low", "N"))


@query("select split_part(name, ' ', 1) || '|umi=' || substr(seq, 1, 4) || '_' || substr(seq, 9, 3) || '|n=' || length(seq) || ' ' || split_part(name, ' ', 2) as name, seq, qual from reads")
def store_tag_in_comment(r):
    r = calc.length(extract.regions(r, [Region("read1", 0, 4), Region("read1", 8, 3)], "umi"), "read1", "n")
    return whole(edits.store_tag_in_comment(edits.store_tag_in_comment(r, "umi", "read1"), "n", "read1"))


@query("select split_part(name, ' ', 1) || '|hit_location=' || case when strpos(seq, 'GAT') > 0 then 'read1:' || (strpos(seq, 'GAT') - 1) || '-' || (strpos(seq, 'GAT') + 2) else '' end || ' ' || split_part(name, ' ', 2) as name, seq, qual from reads")
def store_tag_location_in_comment(r):
    return whole(edits.store_tag_location_in_comment(extract.iupac(r, "read1", ["GAT"], "anywhere", 0, "hit"), "hit", "read1"))


@query(None, paired=True)
def merge_reads(r):
    """Read 2 is made of read 1's end, turned, and a new end, so that most pairs overlap."""
    mate = F.struct(name("read1").alias("name"), edits.reverse_complement(F.concat(F.substring(seq("read1"), F.lit(7), F.lit(99)), F.substring(seq("read2"), 1, 4))).alias("seq"), F.reverse(F.concat(F.substring(qual("read1"), F.lit(7), F.lit(99)), F.substring(qual("read2"), 1, 4))).alias("qual"))
    r = edits.merge(r.with_df(r.df.withColumn("read2", mate)), "read1", "read2", 8, 0.2, 5, "asis", True, out_label="merged")
    return r.df.select(name("read1").alias("name"), seq("read1").alias("seq"), qual("read1").alias("qual"), tag("merged").alias("merged"))


# places

_HIT = "case when p > 0 then p - 1 end as start, case when p > 0 then {n} end as len, case when p > 0 then substr(seq, p, {n}) end as sequence"
_WINDOWS = "list_min(list_filter(list_transform(range(1, length(seq) - {n} + 2), lambda p: {{'d': {d}, 'p': p}}), lambda x: x.d <= {most}))"


@query(f", hits_ as (select name, seq, strpos(seq, nullif(regexp_extract(seq, '[AG]CG[ACT]'), '')) as p from reads) select name, {_HIT.format(n=4)} from hits_", as_hits=True)
def extract_iupac(r):
    return located(extract.iupac(r, "read1", ["RCGH"], "anywhere", 0, "hit"), "hit")


@query(f", hits_ as (select name, seq, {_WINDOWS.format(n=6, d='hamming(substr(seq, p, 6), ' + chr(39) + 'ACGTAC' + chr(39) + ')', most=1)}.p as p from reads where length(seq) >= 6) select name, {_HIT.format(n=6)} from hits_", as_hits=True)
def extract_iupac_mismatch(r):
    return located(extract.iupac(r, "read1", ["ACGTAC"], "anywhere", 1, "hit"), "hit")


@query("select name, case when hamming(substr(seq, 1, 5), 'ACGTA') <= 2 then 0 end as start, case when hamming(substr(seq, 1, 5), 'ACGTA') <= 2 then 5 end as len, case when hamming(substr(seq, 1, 5), 'ACGTA') <= 2 then substr(seq, 1, 5) end as sequence from reads", as_hits=True)
def extract_iupac_left(r):
    return located(extract.iupac(r, "read1", ["ACGTA"], "left", 2, "hit"), "hit")


@query()
def extract_iupac_with_indel(r):
    return located(extract.iupac_with_indel(r, "read1", ["ACGTAC"], "anywhere", "hit", 1, 1, 2), "hit")


@query(", k as (select name, seq, length(seq) as n, list_max(list_filter([2, 3, 4, 5, 6], lambda k: hamming(right(seq, k), left('ACGTCA', k)) <= 1)) as k from reads) select name, n - k as start, k as len, right(seq, k) as sequence from k", as_hits=True)
def extract_iupac_suffix(r):
    return located(extract.iupac_suffix(r, "read1", "ACGTCA", 2, 1, "hit"), "hit")


@query("""select name, case when m <> '' then strpos(seq, m) - 1 end as start, case when m <> '' then length(m) end as len,
    case when m <> '' then regexp_replace(m, '(C+)G(A|T)', '\\2-\\1') end as sequence from (select *, regexp_extract(seq, 'C+G[AT]') as m from reads)""", as_hits=True)
def extract_regex(r):
    return located(extract.regex(r, "read1", "(C+)G(A|T)", "hit", "$2-$1"), "hit")


@query("select name, case when length(seq) >= 24 then substr(seq, 3, 4) || '_' || substr(seq, 21, 4) end as value from reads")
def extract_regions(r):
    r = extract.regions(r, [Region("read1", 2, 4), Region("read1", 20, 4)], "parts")
    return r.df.select(name("read1").alias("name"), joined_sequence(tag("parts"), "_").alias("value"))


@query("select name, length(seq) - 5 as start, 3 as len, substr(seq, length(seq) - 4, 3) as sequence from reads", as_hits=True)
def extract_region_from_end(r):
    return located(extract.regions(r, [Region("read1", -5, 3, "end")], "part"), "part")


_RUN = "case when n > 0 then {s} end as start, case when n > 0 then n end as len, case when n > 0 then substr(seq, {s} + 1, n) end as sequence"


@query(f"select name, {_RUN.format(s=0)} from (select *, length(qual) - length(ltrim(qual, '#+5:<')) as n from reads)", as_hits=True)
def extract_low_quality_start(r):
    return located(extract.low_quality_start(r, "read1", ord("?"), "low"), "low")


@query(f"select name, {_RUN.format(s='length(seq) - n')} from (select *, length(qual) - length(rtrim(qual, '#+5:<')) as n from reads)", as_hits=True)
def extract_low_quality_end(r):
    return located(extract.low_quality_end(r, "read1", ord("?"), "low"), "low")


@query("select name, cast(coalesce(list_sum(list_transform(regexp_extract_all(qual, '[#+5:<]{2,}'), lambda x: length(x))), 0) as bigint) as covered, len(regexp_extract_all(qual, '[#+5:<]{2,}')) as hits from reads")
def extract_regions_of_low_quality(r):
    r = extract.regions_of_low_quality(r, "read1", ord("?"), 2, "low")
    many = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return r.df.select(name("read1").alias("name"), many(calc.hits_length(tag("low"))).alias("covered"), many(F.size(tag("low"))).alias("hits"))


@query(f"select name, {_RUN.format(s='length(seq) - n')} from (select *, case when length(seq) - length(rtrim(seq, 'A')) >= 2 then length(seq) - length(rtrim(seq, 'A')) else 0 end as n from reads)", as_hits=True)
def extract_poly_tail(r):
    return located(extract.poly_tail(r, "read1", "A", 2, 0.0, 1, "tail"), "tail")


@query()
def extract_poly_tail_mismatch(r):
    return located(extract.poly_tail(r, "read1", ".", 4, 0.3, 2, "tail"), "tail")


@query()
def extract_longest_poly_x(r):
    return located(extract.longest_poly_x(r, "read1", ".", 3, 0.25, 2, "run"), "run")


# numbers


@query("select name, cast(length(seq) + length(seq2) as double) as value from reads", paired=True)
def calc_length(r):
    return valued(calc.length(r, "all", "v"), "v")


@query("select name, round(100.0 * (length(seq) - length(translate(seq, 'AT', ''))) / greatest(length(translate(seq, 'N', '')), 1), 6) as value from reads")
def calc_base_content(r):
    return valued(calc.base_content(r, "read1", "AT", "v", "N"), "v", 6)


@query("select name, round(100.0 * (length(seq) - length(translate(seq, 'GC', ''))) / greatest(length(translate(seq, 'N', '')), 1), 6) as value from reads")
def calc_gc_content(r):
    return valued(calc.gc_content(r, "read1", "v"), "v", 6)


@query("select name, cast(length(seq) - length(translate(seq, 'N', '')) as double) as value from reads")
def calc_n_count(r):
    return valued(calc.n_count(r, "read1", "v"), "v")


@query("select name, round(len(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 1) <> substr(seq, i + 1, 1))) / (length(seq) - 1.0), 6) as value from reads")
def calc_complexity(r):
    return valued(calc.complexity(r, "read1", "v"), "v", 6)


@query("select name, cast(length(qual) - length(translate(qual, 'ABCDEFGHI', '')) as double) as value from reads")
def calc_qualified_bases(r):
    return valued(calc.qualified_bases(r, "read1", ord("?"), ">", "v"), "v")


@query("select name, round(list_sum(list_transform(string_split(qual, ''), lambda x: power(10.0, (33 - ascii(x)) / 10.0))), 6) as value from reads")
def calc_expected_error(r):
    return valued(calc.expected_error(r, "read1", "sum", "v"), "v", 6)


@query("select name, round(list_max(list_transform(string_split(qual, ''), lambda x: power(10.0, (33 - ascii(x)) / 10.0))), 6) as value from reads")
def calc_expected_error_max(r):
    return valued(calc.expected_error(r, "read1", "max", "v"), "v", 6)


def calc_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 40")
    side = names.select(F.substring(F.translate(F.md5("c_name"), HEX, BASES), 1, 18).alias("seq"))
    return valued(calc.kmers(reads(spark, sf_dir), "read1", side, 5, True, "v"), "v")


QUERIES["calc_kmers"] = calc_kmers
ORACLE["calc_kmers"] = BASE + """, side as (select distinct unnest(list_transform(range(1, 15), lambda p: substr(s, p, 5))) as kmer from (select translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGN') as s from customer where c_custkey <= 40)),
    known as (select kmer from side where regexp_full_match(kmer, '[ACGT]+') union select reverse(translate(kmer, 'ACGT', 'TGCA')) from side where regexp_full_match(kmer, '[ACGT]+')),
    mine as (select read_no, name, unnest(list_transform(range(1, length(seq) - 3), lambda p: substr(seq, p, 5))) as kmer from reads)
    select name, cast(count(known.kmer) as double) as value from mine left join known using (kmer) group by read_no, name"""


def calc_kmers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As calc_kmers with the names of all customers; of 10 bases, so that most k-mers aren't known."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet")
    side = names.select(F.substring(F.translate(F.md5("c_name"), HEX, BASES), 1, 18).alias("seq"))
    return valued(calc.kmers(reads(spark, sf_dir), "read1", side, 10, True, "v"), "v")


QUERIES["calc_kmers_whole"] = calc_kmers_whole
ORACLE["calc_kmers_whole"] = BASE + """, side as (select distinct unnest(list_transform(range(1, 10), lambda p: substr(s, p, 10))) as kmer from (select translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGN') as s from customer)),
    known as (select kmer from side where regexp_full_match(kmer, '[ACGT]+') union select reverse(translate(kmer, 'ACGT', 'TGCA')) from side where regexp_full_match(kmer, '[ACGT]+')),
    mine as (select read_no, name, unnest(list_transform(range(1, length(seq) - 8), lambda p: substr(seq, p, 10))) as kmer from reads)
    select name, cast(count(known.kmer) as double) as value from mine left join known using (kmer) group by read_no, name"""


@query("select name, cast(case when length(seq) >= 24 then 8 else 0 end as double) as value from reads")
def convert_regions_to_length(r):
    r = extract.regions(r, [Region("read1", 2, 4), Region("read1", 20, 4)], "parts")
    return valued(calc.regions_to_length(r, "parts", "v"), "v")


@query("select name, round(sqrt(length(seq)) + ln(length(seq)) / ln(2) - read_no % 7 * floor(length(seq) / 4), 6) as value from reads", ordered=True)
def eval_expression(r):
    return valued(calc.eval_expression(r, "len_read1 ^ 0.5 + log(2, len_read1) - read_no % 7 * floor(len_read1 / 4)", "numeric", "v"), "v", 6)


# tags from tags


@query("select name, substr(seq, 1, 3) || case when length(seq) >= 24 then substr(seq, 21, 4) else '' end as value from reads")
def concat_tags(r):
    r = extract.regions(extract.regions(r, [Region("read1", 0, 3)], "a"), [Region("read1", 20, 4)], "b")
    r = tags.concat_tags(r, ["a", "b"], "both")
    return r.df.select(name("read1").alias("name"), joined_sequence(tag("both")).alias("value"))


BARCODES = {"ACGT": "one", "TTAA": "two", "GGCC": "three", "CATG": "four"}


@query("select name, case when substr(seq, 1, 4) in ('ACGT', 'TTAA', 'GGCC', 'CATG') then substr(seq, 1, 4) " + " ".join(f"when hamming(substr(seq, 1, 4), '{b}') <= 1 then '{b}'" for b in BARCODES) + " end as value from reads")
def hamming_correct(r):
    r = tags.hamming_correct(extract.regions(r, [Region("read1", 0, 4)], "raw"), "raw", "fixed", list(BARCODES), 1, "remove")
    return r.df.select(name("read1").alias("name"), joined_sequence(tag("fixed")).alias("value"))


_GROUP = "case when substr(seq, 1, 4) = 'ACGT' then 'one' when substr(seq, 1, 4) = 'TTAA' then 'two' when regexp_matches(seq, '^GG[AG]C') then 'three' else 'no-barcode' end"


def _grouped(r: Reads) -> Reads:
    return demultiplex.demultiplex(extract.regions(r, [Region("read1", 0, 4)], "code"), "code", {"ACGT": "one", "TTAA": "two", "GGRC": "three"}, True)


@query(f"select name, {_GROUP} as grp from reads")
def demultiplexed(r):
    return _grouped(r).df.select(name("read1").alias("name"), F.col("_demux").alias("grp"))


@query("select name, read_no > min(read_no) over (partition by seq) as value from reads", ordered=True)
def tag_duplicates(r):
    return valued(tags.duplicates(r, "read1", "v"), "v")


@query(f"select name, read_no > min(read_no) over (partition by {_GROUP}, substr(seq, 1, 6)) as value from reads", ordered=True)
def tag_duplicates_grouped(r):
    r = extract.regions(_grouped(r), [Region("read1", 0, 6)], "umi")
    return valued(tags.duplicates(r, "tag:umi", "v"), "v")


@query(", other as (select distinct split_part(name, ' ', 1) as k from reads where length(seq) = 20 and substr(seq, 1, 1) = 'A') select name, split_part(name, ' ', 1) in (select k from other) as value from reads")
def tag_other_file(r):
    side = r.df.where((F.length(seq("read1")) == 20) & (F.substring(seq("read1"), 1, 1) == "A")).select("read1.name", "read1.seq")
    return valued(tags.other_file(r, "name:read1", side, "v", True, " "), "v")


@query("select name from reads")
def forget_tags(r):
    r = tags.forget(calc.length(calc.n_count(r, "read1", "n"), "read1", "m"), None)
    return r.df.select(name("read1").alias("name"))


# selections


@query("select name, seq, qual from reads where strpos(seq, 'ACG') = 0")
def filter_by_tag(r):
    return whole(filters.by_tag(extract.iupac(r, "read1", ["ACG"], "anywhere", 0, "hit"), "hit", "remove"))


@query("select name, seq, qual from reads where length(seq) >= 20 and length(seq) < 26")
def filter_by_numeric_tag(r):
    return whole(filters.by_numeric_tag(calc.length(r, "read1", "n"), "n", "keep", 20, 26))


@query("select name, seq, qual from (select name, substr(seq, 21) as seq, substr(qual, 21) as qual from reads) where length(seq) > 0")
def filter_empty(r):
    return whole(filters.empty(edits.cut_start(r, "read1", 20), "read1"))


@query("select name, seq, qual from reads where read_no < 500", ordered=True)
def head(r):
    return whole(filters.head(r, 500))


@query(f"select name, seq, qual from (select *, row_number() over (partition by {_GROUP} order by read_no) as k from reads) where k <= 25", ordered=True)
def head_grouped(r):
    return whole(filters.head(_grouped(r), 25))


@query("select name, seq, qual from reads where read_no >= 500", ordered=True)
def skip(r):
    return whole(filters.skip(r, 500))


@query("select name, seq, qual from reads where substr(md5('7-' || read_no), 1, 13) < '4000000000000'", ordered=True)
def filter_sample(r):
    return whole(filters.sample(r, 0.25, 7))


@query(f"select name, seq, qual from (select *, row_number() over (partition by {_GROUP} order by substr(md5('7-' || read_no), 1, 13), read_no) as k from reads) where k <= 20", ordered=True)
def filter_reservoir_sample(r):
    return whole(filters.reservoir_sample(_grouped(r), 20, 7))


# checks


@query("select name, seq, qual from reads")
def validated(r):
    return whole(validate.qualities(validate.sequences(r, "read1", "ACGTN"), "read1", "sanger"))


@query("select name, seq, seq2 from reads", ordered=True, paired=True)
def validated_pairs(r):
    r = validate.read_pairing(validate.names(r, " ", 10), 10)
    return r.df.select(name("read1").alias("name"), seq("read1").alias("seq"), seq("read2").alias("seq2"))


@query("select name, substr(seq, 1, 18) as seq, substr(qual, 1, 18) as qual from reads")
def validated_length(r):
    return whole(validate.same_length(edits.truncate(r, "read1", 18), "read1"))


# stores and reports


@query("select split_part(name, ' ', 1) as ReadName, cast(length(seq) as varchar) as len, substr(seq, 1, 4) || '_' || substr(seq, 9, 3) as umi from reads")
def store_tags_in_table(r):
    r = calc.length(extract.regions(r, [Region("read1", 0, 4), Region("read1", 8, 3)], "umi"), "read1", "len")
    return tags.store_in_table(r).outputs[0].df.select("ReadName", "len", "umi")


@query("select split_part(name, ' ', 1) || '|hit_location=read1:' || (strpos(seq, 'GAT') - 1) || '-' || (strpos(seq, 'GAT') + 2) || ' ' || split_part(name, ' ', 2) as name, 'GAT' as seq, '~~~' as qual from reads where strpos(seq, 'GAT') > 0")
def store_tag_in_fastq(r):
    return tags.store_in_fastq(extract.iupac(r, "read1", ["GAT"], "anywhere", 0, "hit"), "hit").outputs[0].df.select("name", "seq", "qual")


@query("select substr(seq, 1, 4) as key, count(*) as count from reads group by 1")
def quantify_tag(r):
    return tags.quantified(extract.regions(r, [Region("read1", 0, 4)], "code"), "code")


@query(f"select {_GROUP} as grp, count(*) as molecule_count from reads group by 1")
def report_count(r):
    return reports.molecule_count(_grouped(r)).withColumnRenamed("_demux", "grp")


@query("select s as segment, n as length, count(*) as count from (select 'read1' as s, length(seq) as n from reads union all select 'read2', length(seq2) from reads) group by 1, 2", paired=True)
def report_length_distribution(r):
    return reports.length_distribution(r).withColumn("length", F.col("length").cast("long"))


@query("select 'read1' as segment, count(*) - count(distinct seq) as duplicate_count from reads")
def report_duplicate_count_per_read(r):
    return reports.duplicate_count_per_read(r)


@query("select count(*) - count(distinct seq || '-' || seq2) as fragment_duplicate_count from reads", paired=True)
def report_duplicate_count_per_fragment(r):
    return reports.duplicate_count_per_fragment(r)


@query("""select 'read1' as segment, cast(sum(length(seq)) as bigint) as total_bases, cast(sum(length(qual) - length(translate(qual, '5:<?ABCDEFGHI', ''))) as bigint) as q20_bases,
    cast(sum(length(qual) - length(translate(qual, '?ABCDEFGHI', ''))) as bigint) as q30_bases, cast(sum(length(seq) - length(translate(seq, 'GC', ''))) as bigint) as gc_bases from reads""")
def report_base_totals(r):
    return reports.base_totals(r)


@query(""", each as (select p - 1 as position, substr(seq, p, 1) as b, ascii(substr(qual, p, 1)) as q from (select seq, qual, unnest(range(1, length(seq) + 1)) as p from reads))
    select 'read1' as segment, position, count(*) filter (b = 'A') as a, count(*) filter (b = 'C') as c, count(*) filter (b = 'G') as g, count(*) filter (b = 'T') as t,
    count(*) filter (b not in ('A', 'C', 'G', 'T')) as n, round(sum(power(10.0, (33 - q) / 10.0)), 4) as expected_errors from each group by position""")
def report_base_positions(r):
    return reports.base_positions(r).withColumns({"expected_errors": F.round("expected_errors", 4), "position": F.col("position").cast("long")})


@query("select o as oligo, cast(sum(case when strpos(seq, o) > 0 then 1 else 0 end) as bigint) as count from reads, (values ('ACGT'), ('GGG'), ('NN')) t(o) group by o")
def report_count_oligos(r):
    return reports.count_oligos(r, ["ACGT", "GGG", "NN"])


@query("select cast(length(seq) as varchar) as value, count(*) as count from reads group by 1")
def report_tag_histogram(r):
    return reports.tag_histogram(calc.length(r, "read1", "n"), "n")


@query("select name, seq, qual from reads where read_no < 15", ordered=True)
def inspect(r):
    return whole(r.with_df(reports.inspect(r, 15, "x").outputs[0].df))


@query("select count(*) as molecules, cast(floor(count(*) / 1000) as bigint) as steps from reads")
def progress(r):
    return reports.progress(r, 1000).outputs[0].df


@query(""", kept as (select substr(seq, 1, 24) as seq, substr(qual, 1, 24) as qual from reads where length(seq) >= 20 and length(seq) < 30),
    each as (select p - 1 as position, substr(seq, p, 1) as b, ascii(substr(qual, p, 1)) as q from (select seq, qual, unnest(range(1, length(seq) + 1)) as p from kept))
    select 'read1' as segment, position, count(*) filter (b = 'A') as a, count(*) filter (b = 'C') as c, count(*) filter (b = 'G') as g, count(*) filter (b = 'T') as t,
    count(*) filter (b not in ('A', 'C', 'G', 'T')) as n, round(sum(power(10.0, (33 - q) / 10.0)), 4) as expected_errors from each group by position""")
def filtered_report(r):
    """Length, a filter by it, truncation, base statistics: a pipeline from end to end."""
    r = edits.truncate(filters.by_numeric_tag(calc.length(r, "read1", "n"), "n", "keep", 20, 30), "read1", 24)
    return reports.base_positions(r).withColumns({"expected_errors": F.round("expected_errors", 4), "position": F.col("position").cast("long")})
