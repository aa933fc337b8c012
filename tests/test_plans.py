"""Pipelines from TOML over files: readers, writers, checks of the text, side outputs."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandloom.model import ConfigError
from strandloom.plans import engine
from strandloom.plans.config import parse
from strandloom.sources import readers, writers


def fastq(rows):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows)


@pytest.fixture
def rows():
    rng = random.Random(1)
    made = []
    for k in range(300):
        n = rng.randrange(0, 60)
        made.append((f"r{k} c", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("#+@IF", k=n))))
    return made


def collected(df):
    return [(r["name"], r["seq"], r["qual"]) for r in df.orderBy("read_no").collect()]


@pytest.mark.parametrize("size", ["200b", "1k", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_splits(spark, tmp_path, rows, size, end):
    (tmp_path / "a.fq").write_bytes(fastq(rows).replace("\n", end).encode())
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(fastq(rows[:7]).rstrip("\n").encode()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = readers.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")])
        assert collected(df) == rows + rows[:7]
        assert sorted(r[0] for r in df.select("read_no").collect()) == list(range(307))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["@a\nAC\n+\n", "a\nAC\n+\nII\n", "@a\nAC\nII\n+\n", "@a\nAC\n+\nI\n", "@\nAC\n+\nII\n"])
def test_bad_fastq(spark, tmp_path, text):
    (tmp_path / "a.fq").write_text(text)
    with pytest.raises(Exception, match="record|bases|complete"):
        readers.read_fastq(spark, [str(tmp_path / "a.fq")]).collect()


def test_fasta_and_bam(spark, tmp_path, rows):
    (tmp_path / "a.fa").write_text(">one x\nAC\nGT\n>two\n\n>three\nTTT")
    assert readers.sniffed(spark, str(tmp_path / "a.fa")) == "fasta"
    df = readers.read_file(spark, [str(tmp_path / "a.fa")], {"fasta_fake_quality": "F"})
    assert collected(df) == [("one x", "ACGT", "FFFF"), ("two", "", ""), ("three", "TTT", "FFF")]
    (tmp_path / "a.bam").write_bytes(b"".join(writers.bam_bytes(rows)))
    assert readers.sniffed(spark, str(tmp_path / "a.bam")) == "bam"
    got = readers.read_bam(spark, [str(tmp_path / "a.bam")], False, True)
    assert collected(got) == [(n.split(" ")[0], s, q) for n, s, q in rows]
    assert readers.read_bam(spark, [str(tmp_path / "a.bam")], True, False).count() == 0
    with pytest.raises(ConfigError):
        readers.read_file(spark, [str(tmp_path / "a.fa")], {})


def test_bam_of_many_splits(spark, tmp_path):
    rng = random.Random(8)
    many = [(f"r{k} x", "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("!5?IJ", k=n))) for k in range(9000) for n in [rng.randrange(120)]]
    expected = [(n.split(" ")[0], s, q) for n, s, q in many]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(many)], "read_no long, name string, seq string, qual string").repartition(5)
    a, b = str(tmp_path / "a.bam"), str(tmp_path / "b.bam")
    writers.write_reads(df, a, "bam")
    raw = gzip.decompress((tmp_path / "a.bam").read_bytes())
    (tmp_path / "b.bam").write_bytes(gzip.compress(raw))  # one member, no blocks
    for size in ("128m", "70000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_bam(spark, [a, b], False, True)
            assert size == "128m" or got.rdd.getNumPartitions() > 4
            assert collected(got) == expected * 2
            assert [r.read_no for r in got.orderBy("read_no").collect()] == list(range(18_000))
            assert readers.read_bam(spark, [a], True, False).count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    block = writers.bam_block(b"some data" * 40)[18:]
    pieces = [block[:2] + block[2:9], block[9:] + b"x" * 12]  # as if a mark stood in the data
    with pytest.raises(ValueError, match="length|complete"):
        list(readers.bam_blocks(pieces))
    (tmp_path / "c.bam").write_bytes((tmp_path / "a.bam").read_bytes()[:-5000])
    with pytest.raises(Exception, match="complete|EOF|ended"):
        readers.read_bam(spark, [str(tmp_path / "c.bam")], False, True).collect()


def test_zip_and_weave(spark, tmp_path, rows):
    (tmp_path / "a.fq").write_text(fastq(rows))
    df = readers.read_fastq(spark, [str(tmp_path / "a.fq")])
    two = readers.interleaved(df, ["x", "y"])
    got = [(r.x.name, r.y.name) for r in two.df.orderBy("read_no").collect()]
    assert got == [(rows[k][0], rows[k + 1][0]) for k in range(0, 300, 2)]
    with pytest.raises(Exception, match="not complete"):
        readers.interleaved(df.where("read_no < 3"), ["x", "y"]).df.collect()
    with pytest.raises(ValueError, match="different numbers"):
        readers.zipped({"a": df, "b": df.limit(2)})


TOML = """
[input]
    read1 = 'r1.fq'
    read2 = 'r2.fq'
[[step]]
    action = 'report'
    name = 'before'
    length_distribution = true
[[step]]
    action = 'ExtractRegion'
    source = 'read1'
    start = 0
    length = 2
    out_label = 'code'
[[step]]
    action = 'Demultiplex'
    in_label = 'code'
    barcodes = 'plate'
    output_unmatched = true
[[step]]
    action = 'StoreTagsInTable'
    in_labels = ['code']
[[step]]
    action = 'QuantifyTag'
    in_label = 'code'
    infix = 'codes'
[[step]]
    action = 'CutStart'
    segment = 'read1'
    n = 2
    if_tag = 'code'
[[step]]
    action = 'Inspect'
    n = 2
    infix = 'look'
    segment = 'read1'
[[step]]
    action = 'Report'
    name = 'after'
[barcodes.plate]
    AC = 'ac'
    GT = 'gt'
[output]
    prefix = 'out'
    report_json = true
    report_html = true
    Compression = 'gzip'
    output_hash_uncompressed = true
"""


def test_run(spark, tmp_path, rows):
    long = [r for r in rows if len(r[1]) > 4]
    (tmp_path / "r1.fq").write_text(fastq(long))
    (tmp_path / "r2.fq").write_text(fastq(long[::1]))
    engine.run(spark, TOML, str(tmp_path))
    names = {p.name for p in tmp_path.iterdir()}
    for g in ("ac", "gt", "no-barcode"):
        for s in ("read1", "read2"):
            raw = gzip.decompress((tmp_path / f"out_{g}_{s}.fq.gz").read_bytes())
            cut = 2 if s == "read1" else 0
            wanted = [(n, b[cut:], q[cut:]) for n, b, q in long if {"AC": "ac", "GT": "gt"}.get(b[:2], "no-barcode") == g]
            assert raw.decode() == fastq(wanted)
            assert (tmp_path / f"out_{g}_{s}.fq.gz.uncompressed.sha256").read_text() == hashlib.sha256(raw).hexdigest()
        table = (tmp_path / f"out_tags_{g}.tsv").read_text().splitlines()
        assert table[0] == "ReadName\tcode" and len(table) - 1 == len(wanted if g == "no-barcode" else table[1:])
        counts = json.loads((tmp_path / f"out_codes_{g}.qr.json").read_text())
        assert list(counts.values()) == sorted(counts.values(), reverse=True)
    report = json.loads((tmp_path / "out.json").read_text())
    assert report["before"]["molecule_count"] == len(long) and report["report_order"] == ["before", "after"]
    assert sum(report["after"][g]["molecule_count"] for g in ("ac", "gt", "no-barcode")) == len(long)
    assert "out_look_read1.fq" in names and "out.incompleted" not in names and "out.html" in names
    with pytest.raises(FileExistsError):
        engine.run(spark, TOML, str(tmp_path))


def test_chunks_and_weaving(spark, tmp_path, rows):
    for s in ("r1", "r2"):
        (tmp_path / f"{s}.fq").write_text(fastq(rows[:25]))
    head = "[input]\nread1 = 'r1.fq'\nread2 = 'r2.fq'\n[output]\nprefix = 'o'\n"
    engine.run(spark, head + "interleave = ['read2', 'read1']\nchunksize = 10\ncompression = 'zstd'\n", str(tmp_path))
    import zstandard

    text = "".join(zstandard.ZstdDecompressor().stream_reader((tmp_path / f"o_interleaved.{k}.fq.zst").read_bytes()).read().decode() for k in range(3))
    assert text == fastq([r for r in rows[:25] for _ in "xy"])
    engine.run(spark, head.replace("'o'", "'p'") + "format = 'bam'\noutput = ['read1']\n", str(tmp_path))
    assert readers.read_bam(spark, [str(tmp_path / "p_read1.bam")], False, True).count() == 25
    writers.write_parts(readers.read_fastq(spark, [str(tmp_path / "r1.fq")]), str(tmp_path / "parts"), "fasta")
    lines = spark.read.text(str(tmp_path / "parts")).where(F.startswith("value", F.lit(">"))).count()
    assert lines == 25


STEP = "[input]\nread1 = 'a.fq'\n{}\n[output]\nprefix = 'o'\n"


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("[[step]]\naction = 'Nothing'", "unknown action"),
        ("[[step]]\naction = 'Head'", "n is missing"),
        ("[[step]]\naction = 'Head'\nn = 1\nm = 2", "unknown option"),
        ("[[step]]\naction = 'CalcLength'\nout_label = 'x'", "never used"),
        ("[[step]]\naction = 'FilterByTag'\nin_label = 'x'\nkeep_or_remove = 'keep'", "no tag 'x'"),
        ("[[step]]\naction = 'CalcLength'\nout_label = 'read1'", "name of a segment"),
        ("[[step]]\naction = 'CalcLength'\nout_label = 'len_x'", "can't be a tag"),
        ("[[step]]\naction = 'CalcLength'\nout_label = 'x'\n[[step]]\naction = 'CalcLength'\nout_label = 'x'", "declared twice"),
        ("[[step]]\naction = 'Report'\nname = 'x'", "output asks for none"),
        ("[[step]]\naction = 'ExtractIUPAC'\nsearch = 'A'\npattern = 'C'\nanchor = 'left'\nmax_mismatches = 0\nout_label = 'x'", "mean the same"),
        ("[barcodes.b]\nAC = 'x'\nACG = 'y'", "differ in length"),
        ("[nothing]\nx = 1", "unknown section"),
    ],
)
def test_mistakes(text, message):
    with pytest.raises(ConfigError, match=message):
        parse(STEP.format(text))


def test_other_names():
    plan = parse(STEP.format("[[step]]\naction = 'sample'\nP = 0.5\nseed = 1\n[[step]]\naction = 'extract_regex'\nsegment = 'read1'\nquery = 'A'\nout_label = 'x'\n[[step]]\naction = 'ForgetAllTags'"))
    assert [a for a, _ in plan.steps] == ["FilterSample", "ExtractRegex", "ForgetAllTags"]
    assert plan.steps[1][1]["source"] == "read1"
    two = parse("[input]\nread1 = 'a.fq'\nread2 = 'b.fq'\n[output]\nprefix = 'o'\n")
    assert [a for a, _ in two.steps] == ["ValidateReadPairing"]
    with pytest.raises(ConfigError, match="named twice"):
        parse("[input]\nread1 = 'a.fq'\nread2 = 'a.fq'\n[output]\nprefix = 'o'\n")


def test_stream(spark, tmp_path):
    from strandloom.streaming import reads as streaming

    rows = [(k, f"r{k}", "ACGT"[: 1 + k % 3], "IIII"[: 1 + k % 3], f"2024-01-01 00:{k:02d}:00") for k in range(12)]
    df = spark.createDataFrame(rows, "read_no long, name string, seq string, qual string, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(str(tmp_path / "in"))
    once = streaming.without_duplicates(streaming.stream(spark, str(tmp_path / "in")))
    streaming.drain(once.df.select("read_no", "read1.seq"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "AC", "ACG"]


def test_standard_streams(spark, tmp_path, rows, monkeypatch, capsys):
    import io
    import types

    from strandloom.__main__ import main

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(fastq(rows[:9]).encode())))
    engine.run(spark, "[input]\nread1 = '--stdin--'\n[[step]]\naction = 'Head'\nn = 5\n[output]\nprefix = 'o'\nstdout = true\n", str(tmp_path))
    assert capsys.readouterr().out == fastq(rows[:5])
    (tmp_path / "a.toml").write_text(STEP.format("[[step]]\naction = 'Head'"))
    assert main(["validate", str(tmp_path / "a.toml")]) == 1
    assert "n is missing" in capsys.readouterr().err
    assert main(["list-steps"]) == 0 and "ExtractIUPAC" in capsys.readouterr().out


def test_checks_run_whatever_the_sinks_read(spark, tmp_path, rows):
    from strandloom.operators import edits, filters, validate

    (tmp_path / "a.fq").write_text(fastq([*rows[:20], ("bad c", "ACXT", "IIII")]))
    text = "[input]\nread1 = 'a.fq'\n[[step]]\naction = 'ValidateSeq'\nsegment = 'read1'\nallowed = 'ACGT'\n[[step]]\naction = 'Report'\nname = 'r'\n[output]\nprefix = 'o'\nformat = 'none'\nreport_json = true\n"
    with pytest.raises(Exception, match="aren't allowed"):
        engine.run(spark, text, str(tmp_path))
    r = readers.one_segment(readers.read_file(spark, [str(tmp_path / "a.fq")], {}))
    for bad in (validate.sequences(r, "read1", "ACGT"), validate.qualities(r.with_df(r.df.withColumn("read1", F.col("read1").withField("qual", F.lit("\x7f")))), "read1", "sanger")):
        for df in (bad.df.groupBy().count(), bad.df.select("read_no"), bad.df.select("read1.name")):
            with pytest.raises(Exception, match="aren't allowed|outside"):
                df.collect()
    low = r.with_df(r.df.withColumn("read1", F.col("read1").withField("qual", F.lit("\x1f"))))
    with pytest.raises(Exception, match="quality outside"):
        edits.convert_quality(low, "sanger", "illumina13").df.groupBy().count().collect()
    # what an earlier step removes is not checked, also across a join
    kept = filters.kept(r, F.col("read1.name") != "bad c")
    assert validate.sequences(kept, "read1", "ACGT").df.groupBy().count().first()[0] == 20
    joined = r.with_df(r.df.join(spark.range(20).withColumnRenamed("id", "read_no"), "read_no"))
    assert validate.sequences(joined, "read1", "ACGT").df.groupBy().count().first()[0] == 20


def test_no_file_is_overwritten(spark, tmp_path, rows):
    (tmp_path / "r1.fq").write_text(fastq(rows[:30]))
    head = "[input]\nread1 = 'r1.fq'\n[[step]]\naction = 'CalcLength'\nsegment = 'read1'\nout_label = 'n'\n[[step]]\naction = 'StoreTagsInTable'\n[[step]]\naction = 'Inspect'\nn = 3\ninfix = 'look'\nsegment = 'read1'\n[output]\nprefix = 'o'\n"
    engine.run(spark, head + "chunksize = 10\nreport_html = false\n", str(tmp_path))
    made = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert {"o_read1.0.fq", "o_read1.2.fq", "o_tags.tsv", "o_look_read1.fq"} <= set(made)
    for own in (("o_read1.0.fq", "o_read1.1.fq", "o_read1.2.fq"), ("o_tags.tsv",), ("o_look_read1.fq",)):
        for n in made:
            (tmp_path / n).unlink(missing_ok=True) if n.startswith("o_") and n not in own else None
        with pytest.raises(FileExistsError):
            engine.run(spark, head + "chunksize = 10\n", str(tmp_path))
        for n, data in made.items():
            (tmp_path / n).write_bytes(data)


def test_groups_without_any_barcode(spark, tmp_path, rows):
    (tmp_path / "r1.fq").write_text(fastq([r for r in rows if len(r[1]) > 5]))
    text = "[input]\nread1 = 'r1.fq'\n[[step]]\naction = 'ExtractRegion'\nsource = 'read1'\nstart = 0\nlength = 3\nout_label = 'code'\n[[step]]\naction = 'Demultiplex'\nin_label = 'code'\nbarcodes = 'b'\noutput_unmatched = true\n[barcodes.b]\nAC = 'x'\nGT = 'y'\n[output]\nprefix = 'o'\n"
    with pytest.raises(ValueError, match="no molecule"):
        engine.run(spark, text, str(tmp_path))


def test_files_are_opened_by_content(spark, tmp_path, rows):
    import zstandard

    (tmp_path / "a").write_bytes(gzip.compress(fastq(rows).encode()))
    (tmp_path / "b.gz").write_bytes(zstandard.compress(fastq(rows[:9]).encode()))
    (tmp_path / "c.fq").write_text(fastq(rows))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert collected(readers.read_file(spark, [str(tmp_path / "a")], {})) == rows
        assert collected(readers.read_file(spark, [str(tmp_path / "b.gz")], {})) == rows[:9]
        assert collected(readers.read_file(spark, [str(tmp_path / "c.fq")], {})) == rows
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    with pytest.raises(FileNotFoundError):
        readers.sniffed(spark, str(tmp_path / "none"))
