"""Queries that write files and read them back: sources, sinks and whole runs from TOML, with the same in SQL.

Each writes to a folder of its own below spark.checkpoint.dir, or a temporary
one for a local master, that goes with the session.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.model import Reads, name, qual, seq
from strandloom.plans import engine
from strandloom.sources import readers, writers
from strandloom.streaming import reads as streaming

#: Reads in a chunk of chunked_files.
CHUNK = 2500


def fresh_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base.removeprefix("file://") if base and "://" not in base.removeprefix("file://") else None
    folder = tempfile.mkdtemp(prefix="strandloom-", dir=base if base and os.path.isdir(base) else None)
    atexit.register(shutil.rmtree, folder, True)
    return folder


def files_query(sql: str, paired: bool = False):
    """Registers a function of (session, reads in order, folder) under its name; sql: what follows the reads in the oracle's text."""

    def put(make):
        queries.QUERIES[make.__name__] = lambda spark, sf_dir: make(spark, queries.reads(spark, sf_dir, ordered=True, paired=paired), fresh_folder(spark))
        queries.ORACLE[make.__name__] = f"{queries.BASE}{sql}" if sql.startswith(",") else f"{queries.BASE} {sql}"
        return make

    return put


def flat(r: Reads, s: str = "read1") -> DataFrame:
    return r.df.select("read_no", name(s).alias("name"), seq(s).alias("seq"), qual(s).alias("qual"))


def ran(spark: SparkSession, r: Reads, folder: str, text: str) -> str:
    """Writes the reads' segments as in_<segment>.fq and runs a pipeline's text over them; gives the prefix of what it wrote."""
    for s in r.segments:
        writers.write_reads(flat(r, s), f"{folder}/in_{s}.fq", "fastq")
    heads = "\n".join(f"{s} = 'in_{s}.fq'" for s in r.segments)
    engine.run(spark, f"[input]\n{heads}\n{text}", folder)
    return f"{folder}/out"


@files_query("select read_no, name, seq, qual from reads")
def fastq_files(spark, r, folder):
    """FASTQ written and read, its format found by its content."""
    writers.write_reads(flat(r), f"{folder}/a.fq", "fastq")
    return readers.read_file(spark, [f"{folder}/a.fq"], {})


@files_query("select read_no, name, seq, qual from reads")
def gzip_files_by_content(spark, r, folder):
    """Two gzip files one after another, under names that don't tell."""
    half = r.df.count() // 2
    writers.write_reads(flat(r).where(F.col("read_no") < half), f"{folder}/a.fq", "fastq", "gzip")
    writers.write_reads(flat(r).where(F.col("read_no") >= half), f"{folder}/b.data", "fastq", "gzip")
    return readers.read_file(spark, [f"{folder}/a.fq", f"{folder}/b.data"], {})


@files_query("select sha256(string_agg('@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || qual || chr(10), '' order by read_no)) as uncompressed from reads")
def file_hashes(spark, r, folder):
    """The SHA-256 beside a zstd file."""
    writers.write_reads(flat(r), f"{folder}/a.fq.zst", "fastq", "zstd", hash_raw=True, hash_compressed=True)
    return spark.read.text(f"{folder}/a.fq.zst.uncompressed.sha256").withColumnRenamed("value", "uncompressed")


@files_query("select read_no, name, seq, repeat('F', length(seq)) as qual from reads")
def fasta_files(spark, r, folder):
    writers.write_reads(flat(r), f"{folder}/a.fa", "fasta")
    return readers.read_file(spark, [f"{folder}/a.fa"], {"fasta_fake_quality": "F"})


@files_query("select read_no, split_part(name, ' ', 1) as name, seq, qual from reads")
def bam_files(spark, r, folder):
    writers.write_reads(flat(r), f"{folder}/a.bam", "bam")
    return readers.read_file(spark, [f"{folder}/a.bam"], {"bam_include_mapped": False, "bam_include_unmapped": True})


@files_query("select name, seq, qual from reads")
def parts_folder(spark, r, folder):
    """A folder of parts written by the executors, in order."""
    writers.write_parts(flat(r), f"{folder}/parts", "fastq", "gzip")
    lines = spark.read.option("lineSep", "\n@").text(f"{folder}/parts").withColumn("value", F.split(F.regexp_replace("value", r"\A@|\n\z", ""), "\n"))
    return lines.select(F.col("value")[0].alias("name"), F.col("value")[1].alias("seq"), F.col("value")[3].alias("qual"))


@files_query("select read_no, name, seq, seq2 from reads", paired=True)
def interleaved_files(spark, r, folder):
    writers.write_reads(engine.records(r.df, ["read1", "read2"]), f"{folder}/a.fq", "fastq", order="read_no,place")
    two = readers.interleaved(readers.read_file(spark, [f"{folder}/a.fq"], {}), ["read1", "read2"])
    return two.df.select("read_no", name("read1").alias("name"), seq("read1").alias("seq"), seq("read2").alias("seq2"))


@files_query("select read_no, name, seq, qual2 from reads", paired=True)
def segment_files(spark, r, folder):
    for s in r.segments:
        writers.write_reads(flat(r, s), f"{folder}/{s}.fq", "fastq")
    two = readers.zipped({s: readers.read_file(spark, [f"{folder}/{s}.fq"], {}) for s in r.segments})
    return two.df.select("read_no", name("read1").alias("name"), seq("read1").alias("seq"), qual("read2").alias("qual2"))


@files_query(f"select cast(floor(read_no / {CHUNK}) as bigint) as chunk, name, substr(seq, 3) as seq from reads where read_no < 4 * {CHUNK}")
def chunked_files(spark, r, folder):
    """A run whose output is cut into files of so many reads."""
    out = ran(spark, r, folder, f"[[step]]\naction = 'Head'\nn = {4 * CHUNK}\n[[step]]\naction = 'CutStart'\nsegment = 'read1'\nn = 2\n[output]\nprefix = 'out'\nchunksize = {CHUNK}\ncompression = 'gzip'\n")
    frames = [readers.read_file(spark, [f"{folder}/{f}"], {}).select(F.lit(int(f.split(".")[1])).cast("long").alias("chunk"), "name", "seq") for f in sorted(os.listdir(folder)) if f.startswith(f"{os.path.basename(out)}_read1.")]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionAll(f)
    return whole


PLATE = "[barcodes.plate]\nAC = 'ac'\nGT = 'gt'\n"
GROUP = "case substr(seq, 1, 2) when 'AC' then 'ac' when 'GT' then 'gt' else 'no-barcode' end"
SPLIT = "[[step]]\naction = 'ExtractRegion'\nsource = 'read1'\nstart = 0\nlength = 2\nout_label = 'code'\n[[step]]\naction = 'Demultiplex'\nin_label = 'code'\nbarcodes = 'plate'\noutput_unmatched = true\n"


@files_query(f"select {GROUP} as grp, name, seq from reads")
def demultiplexed_files(spark, r, folder):
    """A run that writes a file for each barcode."""
    out = ran(spark, r, folder, f"{SPLIT}{PLATE}[output]\nprefix = 'out'\n")
    frames = [readers.read_file(spark, [f"{out}_{g}_read1.fq"], {}).select(F.lit(g).alias("grp"), "name", "seq") for g in ("ac", "gt", "no-barcode")]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@files_query("select split_part(name, ' ', 1) as ReadName, substr(seq, 1, 2) as code, cast(length(seq) as varchar) as n from reads")
def table_file(spark, r, folder):
    """A run without reads as output, for its table, compressed."""
    steps = "[[step]]\naction = 'ExtractRegion'\nsource = 'read1'\nstart = 0\nlength = 2\nout_label = 'code'\n[[step]]\naction = 'CalcLength'\nsegment = 'read1'\nout_label = 'n'\n[[step]]\naction = 'StoreTagsInTable'\ncompression = 'gzip'\n"
    out = ran(spark, r, folder, f"{steps}[output]\nprefix = 'out'\nformat = 'none'\n")
    return spark.read.option("sep", "\t").option("header", True).csv(f"{out}_tags.tsv.gz").select("ReadName", "code", "n")


@files_query("select substr(seq, 1, 2) as key, count(*) as count from reads group by 1")
def counts_file(spark, r, folder):
    steps = "[[step]]\naction = 'ExtractRegion'\nsource = 'read1'\nstart = 0\nlength = 2\nout_label = 'code'\n[[step]]\naction = 'QuantifyTag'\nin_label = 'code'\ninfix = 'codes'\n"
    out = ran(spark, r, folder, f"{steps}[output]\nprefix = 'out'\nformat = 'none'\n")
    with open(f"{out}_codes.qr.json") as f:
        return spark.createDataFrame(list(json.load(f).items()), "key string, count long")


@files_query(f"select {GROUP} as grp, count(*) as molecule_count, cast(sum(length(seq)) as bigint) as total_bases, count(*) - count(distinct seq) as duplicate_count from reads group by 1")
def json_report(spark, r, folder):
    """The report of a run, with groups."""
    out = ran(spark, r, folder, f"{SPLIT}[[step]]\naction = 'Report'\nname = 'end'\nbase_statistics = true\nduplicate_count_per_read = true\n{PLATE}[output]\nprefix = 'out'\nformat = 'none'\nreport_json = true\nreport_html = true\n")
    with open(f"{out}.json") as f:
        found = json.load(f)["end"]
    rows = [(g, x["molecule_count"], x["read1"]["base_statistics"]["total_bases"], x["read1"]["duplicate_count"]) for g, x in found.items()]
    return spark.createDataFrame(rows, "grp string, molecule_count long, total_bases long, duplicate_count long")


@files_query("select name, seq, qual from reads where read_no < 40")
def inspected_file(spark, r, folder):
    out = ran(spark, r, folder, "[[step]]\naction = 'Inspect'\nn = 40\ninfix = 'look'\nsegment = 'read1'\ncompression = 'zstd'\nsuffix = 'txt'\n[output]\nprefix = 'out'\nformat = 'none'\n")
    return readers.read_file(spark, [f"{out}_look_read1.txt.zst"], {}).select("name", "seq", "qual")


@files_query("select name, seq, qual from reads where strpos(seq, 'GAT') > 0")
def other_file(spark, r, folder):
    """Reads whose name is in another file."""
    writers.write_reads(flat(r).where(F.contains("seq", F.lit("GAT"))), f"{folder}/other.fq", "fastq")
    out = ran(spark, r, folder, "[[step]]\naction = 'TagOtherFile'\nsource = 'name:read1'\nfilename = 'other.fq'\nout_label = 'there'\nother_readname_end_character = ' '\n[[step]]\naction = 'FilterByTag'\nin_label = 'there'\nkeep_or_remove = 'keep'\n[output]\nprefix = 'out'\n")
    return readers.read_file(spark, [f"{out}_read1.fq"], {}).select("name", "seq", "qual")


@files_query("select count(*) as molecules from reads")
def validated_count(spark, r, folder):
    """Checks run though nothing but the number of molecules is asked for."""
    from strandloom.operators import validate

    return validate.qualities(validate.sequences(r, "read1", "ACGTN"), "read1", "sanger").df.agg(F.count("*").alias("molecules"))


@files_query("select seq, count(*) as count from (select distinct seq from reads where length(seq) < 21) group by 1")
def streamed_without_duplicates(spark, r, folder):
    """Reads that arrive as files, each sequence once."""
    rows = flat(r).where(F.length("seq") < 21).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("read_no") % 600))
    rows.write.parquet(f"{folder}/in")
    once = streaming.without_duplicates(streaming.stream(spark, f"{folder}/in", 10_000))
    streaming.drain(once.df.select("read1.seq"), f"{folder}/out", f"{folder}/check")
    return spark.read.parquet(f"{folder}/out").groupBy("seq").agg(F.count("*").alias("count"))
