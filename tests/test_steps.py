"""Steps on small reads, with values worked out by hand from the rules."""

import pytest

from strandloom.functions.dna import reverse_complement_text
from strandloom.model import ConfigError, TagType, joined_sequence, tag
from strandloom.operators import calc, demultiplex, edits, extract, filters, reports, tags, validate
from strandloom.operators.extract import Region
from pyspark.sql import functions as F


def texts(r, segment="read1"):
    return [(x[segment]["seq"], x[segment]["qual"]) for x in r.df.orderBy("read_no").collect()]


def hits(r, label):
    return [None if x[0] is None else [(h["start"], h["len"], h["sequence"]) for h in x[0]] for x in r.df.orderBy("read_no").select(f"t_{label}").collect()]


def values(r, label):
    return [x[0] for x in r.df.orderBy("read_no").select(f"t_{label}").collect()]


def test_cuts_move_hits(reads_of):
    r = extract.regions(reads_of(("a", "ACGTACGT", "ABCDEFGH"), ("b", "AC")), [Region("read1", 2, 3)], "x")
    assert hits(r, "x") == [[(2, 3, "GTA")], None]
    assert texts(edits.cut_start(r, "read1", 2)) == [("GTACGT", "CDEFGH"), ("", "")]
    assert hits(edits.cut_start(r, "read1", 2), "x") == [[(0, 3, "GTA")], None]
    assert hits(edits.cut_start(r, "read1", 3), "x") == [[(None, None, "GTA")], None]
    assert hits(edits.cut_end(r, "read1", 3), "x") == [[(2, 3, "GTA")], None]
    assert hits(edits.cut_end(r, "read1", 4), "x") == [[(None, None, "GTA")], None]
    assert hits(edits.truncate(r, "read1", 0), "x") == [[(None, None, "GTA")], None]
    assert hits(edits.prefix(r, "read1", "TT", "II"), "x")[0] == [(4, 3, "GTA")]
    turned = edits.reverse_complement_step(r, "read1")
    assert texts(turned)[0] == ("ACGTACGT", "HGFEDCBA")
    assert hits(turned, "x")[0] == [(3, 3, "TAC")]


def test_one_lost_hit_loses_all_places(reads_of):
    r = extract.regions(reads_of(("a", "ACGTACGT")), [Region("read1", 0, 2), Region("read1", 4, 2)], "x")
    assert hits(edits.cut_start(r, "read1", 1), "x") == [[(None, None, "AC"), (None, None, "AC")]]


def test_conditions(reads_of):
    r = extract.iupac(reads_of(("a", "ACGT"), ("b", "TTTT")), "read1", ["ACG"], "left", 0, "x")
    assert [t[0] for t in texts(edits.cut_start(r, "read1", 1, "x"))] == ["CGT", "TTTT"]
    assert [t[0] for t in texts(edits.cut_start(r, "read1", 1, "!x"))] == ["ACGT", "TTT"]


def test_trim_at_tag(reads_of):
    r = extract.iupac(reads_of(("a", "AACGTT"), ("b", "TTTTTT")), "read1", ["CG"], "anywhere", 0, "x")
    wanted = {("start", True): "CGTT", ("start", False): "TT", ("end", True): "AACG", ("end", False): "AA"}
    for (side, keep), left in wanted.items():
        cut = edits.trim_at_tag(r, "x", side, keep)
        assert [t[0] for t in texts(cut)] == [left, "TTTTTT"]
    assert hits(edits.trim_at_tag(r, "x", "start", True), "x")[0] == [(0, 2, "CG")]
    many = extract.regions(reads_of(("a", "ACGTACGT")), [Region("read1", 0, 2), Region("read1", 4, 2)], "x")
    with pytest.raises(ConfigError):
        edits.trim_at_tag(many, "x", "end", True)


def test_convert_quality(reads_of):
    assert texts(edits.convert_quality(reads_of(("a", "AC", "!I")), "sanger", "illumina1.3")) == [("AC", "@h")]
    old, new = edits.quality_table("sanger", "solexa")
    assert dict(zip(old, new))["!"] == ";" and dict(zip(old, new))["I"] == "h"
    with pytest.raises(Exception, match="quality outside"):
        texts(edits.convert_quality(reads_of(("a", "A", "!")), "illumina13", "sanger"))


def test_swap_and_rename(reads_of):
    r = reads_of(read1=[("a 1", "AC")], read2=[("a 2", "GT")])
    r = extract.regions(r, [Region("read2", 0, 1)], "x")
    swapped = edits.swap(r, "read1", "read2")
    assert texts(swapped)[0][0] == "GT" and swapped.df.first()["t_x"][0]["segment"] == 0
    renamed = edits.rename(filters.skip(reads_of(("x", "A"), ("y", "C"), ("z", "G")), 1), "^(.)", "$1_{{READ_INDEX}}")
    assert [x.read1.name for x in renamed.df.orderBy("read_no").collect()] == ["y_0", "z_1"]


def test_store_in_sequence(reads_of):
    r = edits.change_case(extract.regions(reads_of(("a", "ACGTAC", "ABCDEF")), [Region("read1", 1, 2)], "x"), "tag:x", False)
    assert texts(edits.store_tag_in_sequence(r, "x")) == [("AcgTAC", "ABCDEF")]
    r = extract.regex(reads_of(("a", "ACGTAC", "ABCDEF")), "read1", "CG", "x", "TTT")
    longer = edits.store_tag_in_sequence(r, "x")
    assert texts(longer) == [("ATTTTAC", "ACCCDEF")]
    assert hits(longer, "x") == [[(None, None, "TTT")]]
    assert texts(edits.replace_tag_with_letter(r, "x", "N")) == [("ANNTAC", "ABCDEF")]


def test_comments(reads_of):
    r = extract.regions(reads_of(("a x", "ACGTAC")), [Region("read1", 1, 2)], "u")
    assert edits.store_tag_in_comment(r, "u").df.first().read1.name == "a|u=CG x"
    assert edits.store_tag_location_in_comment(r, "u").df.first().read1.name == "a|u_location=read1:1-3 x"
    numbers = [12.0, 0.12345, 1e-7, 12345678.5]
    spark = r.df.sparkSession
    shown = [x[0] for x in spark.createDataFrame([(n,) for n in numbers], "v double").select(edits.number_text(F.col("v"))).collect()]
    assert shown == ["12", "0.1235", "1e-7", "1.2346e7"] or shown[:2] == ["12", "0.1235"]


def test_iupac(reads_of):
    r = reads_of(("a", "TTACGN"), ("b", "acgttt"), ("c", "AC"), ("d", "NCGNNN"))
    assert hits(extract.iupac(r, "read1", ["ACG"], "anywhere", 0, "x"), "x") == [[(2, 3, "ACG")], [(0, 3, "acg")], None, None]
    assert hits(extract.iupac(r, "read1", ["ACG"], "anywhere", 1, "x"), "x") == [[(2, 3, "ACG")], [(0, 3, "acg")], None, [(0, 3, "NCG")]]
    assert hits(extract.iupac(r, "read1", ["CGN"], "right", 0, "x"), "x") == [[(3, 3, "CGN")], None, None, None]
    assert hits(extract.iupac(r, "read1", ["GGG", "TTT"], "right", 0, "x"), "x")[1] == [(3, 3, "ttt")]


def test_indels(reads_of):
    r = reads_of(("a", "TTACGTACTT"), ("b", "TTACTACTT"), ("c", "GGGGGGGG"))
    got = hits(extract.iupac_with_indel(r, "read1", ["ACGTAC"], "anywhere", "x", 0, 1), "x")
    assert got == [[(2, 6, "ACGTAC")], [(2, 5, "ACTAC")], None]


def test_suffix_and_regex(reads_of):
    r = reads_of(("a", "TTTACG"), ("b", "TTTTTT"), ("c", "ACGTAA"))
    assert hits(extract.iupac_suffix(r, "read1", "ACGTCC", 2, 0, "x"), "x") == [[(3, 3, "ACG")], None, None]
    assert hits(extract.regex(r, "read1", "T(A)(C)", "x", "$2-$1"), "x") == [[(2, 3, "C-A")], None, None]
    assert values(extract.regex(r, "name:read1", "[ab]", "x"), "x") == ["a", "b", None]


def test_regions(reads_of):
    r = reads_of(("a", "ACGTACGT"), ("b", "ACG"))
    assert hits(extract.regions(r, [Region("read1", -3, 2, "end")], "x"), "x") == [[(5, 2, "CG")], [(0, 2, "AC")]]
    assert hits(extract.regions(r, [Region("read1", 2, 2)], "x"), "x") == [[(2, 2, "GT")], None]
    by_tag = extract.regions(extract.iupac(r, "read1", ["GTA"], "anywhere", 0, "h"), [Region("tag:h", 0, 2, "end")], "x")
    assert hits(by_tag, "x") == [[(5, 2, "CG")], None]
    mixed = extract.regions(r, [Region("read1", 0, 2), Region("name:read1", 0, 1)], "x")
    assert mixed.tags["x"] is TagType.STRING and values(mixed, "x") == ["ACa", "ACb"]


def test_tails(reads_of):
    r = reads_of(("a", "CGTAAAATAA"), ("b", "ACGT"), ("c", "GGGGGG"))
    assert hits(extract.poly_tail(r, "read1", "A", 3, 0.0, 0, "x"), "x") == [None, None, None]
    assert hits(extract.poly_tail(r, "read1", "A", 4, 0.2, 1, "x"), "x") == [[(3, 7, "AAAATAA")], None, None]
    assert hits(extract.poly_tail(r, "read1", ".", 3, 0.2, 1, "x"), "x")[2] == [(0, 6, "GGGGGG")]
    assert hits(extract.longest_poly_x(r, "read1", "A", 3, 0.0, 1, "x"), "x") == [[(3, 4, "AAAA")], None, None]
    assert hits(extract.longest_poly_x(r, "read1", ".", 3, 0.2, 2, "x"), "x")[0] == [(3, 7, "AAAATAA")]


def test_qualities(reads_of):
    r = reads_of(("a", "ACGTAC", "##II##"), ("b", "ACGT", "IIII"))
    assert hits(extract.low_quality_start(r, "read1", 64, "x"), "x") == [[(0, 2, "AC")], None]
    assert hits(extract.low_quality_end(r, "read1", 64, "x"), "x") == [[(4, 2, "AC")], None]
    assert hits(extract.regions_of_low_quality(r, "read1", 64, 1, "x"), "x") == [[(0, 2, "AC"), (4, 2, "AC")], None]
    assert values(calc.expected_error(r, "read1", "max", "e"), "e")[1] == pytest.approx(1e-4)


def test_numbers(reads_of):
    r = reads_of(("a", "GGCNaa"), ("b", "T"), ("c", ""))
    assert values(calc.gc_content(r, "read1", "v"), "v") == [60.0, 0.0, 0.0]
    assert values(calc.n_count(r, "read1", "v"), "v") == [1.0, 0.0, 0.0]
    assert values(calc.complexity(r, "read1", "v"), "v") == [pytest.approx(0.6), 0.0, 0.0]
    e = calc.eval_expression(calc.length(r, "read1", "n"), "max(n, 2) ^ 2 - -1 * (n >= 1 and n < 6)", "numeric", "v")
    assert values(e, "v") == [36.0, 5.0, 4.0]
    with pytest.raises(ConfigError):
        calc.eval_expression(r, "nothing + 1", "numeric", "v")
    with pytest.raises(ConfigError):
        calc.eval_expression(calc.length(r, "read1", "n"), "(n + 1", "numeric", "v")


def test_merge(reads_of):
    a, b = "ACGTTGCAACGGTT", "GCAACGGTTCCATG"
    r = reads_of(read1=[("x", a), ("y", "A" * 12)], read2=[("x", reverse_complement_text(b)), ("y", "A" * 12)])
    m = edits.merge(r, "read1", "read2", 6, 0.1, 2, "asis", True, out_label="m")
    assert [t[0] for t in texts(m)] == ["ACGTTGCAACGGTTCCATG", "A" * 12]
    assert [t[0] for t in texts(m, "read2")] == ["", "A" * 12] and values(m, "m") == [True, False]
    c = edits.merge(r, "read1", "read2", 6, 0.1, 2, "concatenate", True, "NN", 35)
    assert texts(c)[1] == ("A" * 12 + "NN" + "T" * 12, "I" * 12 + "##" + "I" * 12)


def test_hamming_and_groups(reads_of):
    r = extract.regions(reads_of(("a", "ACGTT"), ("b", "ACGAT"), ("c", "GGGGG"), ("d", "AC")), [Region("read1", 0, 4)], "x")
    fix = lambda how: tags.hamming_correct(r, "x", "y", ["ACGT", "TTTT"], 1, how)
    assert [h and h[0][2] for h in hits(fix("remove"), "y")] == ["ACGT", "ACGT", None, None]
    assert [h and h[0][2] for h in hits(fix("keep"), "y")] == ["ACGT", "ACGT", "GGGG", None]
    assert [h and h[0][2] for h in hits(fix("empty"), "y")] == ["ACGT", "ACGT", "", None]
    d = demultiplex.demultiplex(fix("remove"), "y", {"ACGT": "one", "TTTT": "two"}, False)
    assert [x[0] for x in d.df.orderBy("read_no").select("_demux").collect()] == ["one", "one", None, None]
    assert filters.head(d, 1).df.count() == 2
    assert sorted(x.read_no for x in filters.skip(d, 1).df.collect()) == [1, 3]
    two = demultiplex.demultiplex(tags.duplicates(d, "read1", "dup"), "dup")
    assert [x[0] for x in two.df.orderBy("read_no").select("_demux").collect()][:2] == ["one_dup=false", "one_dup=false"]
    with pytest.raises(ConfigError):
        demultiplex.check_barcodes({"ACGN": "a", "ACGT": "b"})


def test_duplicates_and_files(reads_of, spark):
    r = reads_of(("a 1", "AC"), ("b", "AC"), ("a 2", "GT"))
    assert values(tags.duplicates(r, "read1", "d"), "d") == [False, True, False]
    assert values(tags.duplicates(r, "name:read1", "d"), "d") == [False, False, True]
    side = spark.createDataFrame([("a", "GT")], "name string, seq string")
    assert values(tags.other_file(r, "read1", side, "o"), "o") == [False, False, True]
    assert values(tags.other_file(r, "name:read1", side, "o", True), "o") == [True, False, True]
    with pytest.raises(ConfigError):
        tags.other_file(r, "read1", side.limit(0), "o")


def test_kmers(reads_of, spark):
    side = spark.createDataFrame([("ACGTT",)], "seq string")
    r = reads_of(("a", "ACGACG"), ("b", "AACC"), ("c", "AC"))
    assert values(calc.kmers(r, "read1", side, 3, False, "k"), "k") == [2.0, 0.0, 0.0]
    assert values(calc.kmers(r, "read1", side, 3, True, "k"), "k") == [2.0, 1.0, 0.0]


def test_concat(reads_of):
    r = extract.regions(extract.regions(reads_of(("a", "ACGTAC"), ("b", "ACG")), [Region("read1", 0, 2)], "x"), [Region("read1", 3, 2)], "y")
    assert [None if h is None else [q[2] for q in h] for h in hits(tags.concat_tags(r, ["x", "y"], "z"), "z")] == [["AC", "TA"], ["AC"]]
    assert hits(tags.concat_tags(r, ["x", "y"], "z", on_missing="set_missing"), "z")[1] is None


def test_checks(reads_of):
    bad = reads_of(("a", "AX"))
    with pytest.raises(Exception, match="ValidateSeq"):
        texts(validate.sequences(bad, "read1", "ACGT"))
    pair = reads_of(read1=[("q/1", "A")], read2=[("q/2", "C")])
    assert texts(validate.read_pairing(pair))
    with pytest.raises(Exception, match="ValidateReadPairing"):
        texts(validate.read_pairing(reads_of(read1=[("qq/1", "A")], read2=[("rr/2", "C")])))
    assert texts(validate.names(pair, "/", 1))
    with pytest.raises(Exception, match="ValidateAllReadsSameLength"):
        texts(validate.same_length(reads_of(("a", "A"), ("b", "AC")), "read1"))


def test_samples(reads_of):
    r = reads_of(*((f"r{k}", "ACGT") for k in range(200)))
    assert 20 < filters.sample(r, 0.25, 3).df.count() < 90
    assert filters.reservoir_sample(r, 7, 3).df.count() == 7
    assert filters.reservoir_sample(r, 7, 3).df.select("read_no").collect() == filters.reservoir_sample(r, 7, 3).df.select("read_no").collect()


def test_report_json(reads_of):
    r = reads_of(("a", "ACG", "I5#"), ("b", "ACG", "III"), ("c", "A", "I"))
    r = reports.report(r, "x", set(reports.PARTS), ["AC"])
    made = reports.assembled([(o.details, o.df.collect()) for o in r.outputs])
    assert made["molecule_count"] == 3 and made["fragment_duplicate_count"] == 1
    assert made["read1"]["length_distribution"] == [0, 1, 0, 2] and made["read1"]["duplicate_count"] == 1
    stats = made["read1"]["base_statistics"]
    assert (stats["total_bases"], stats["q20_bases"], stats["q30_bases"], stats["gc_bases"]) == (7, 6, 5, 4)
    assert stats["per_position_counts"]["a"] == [3, 0, 0] and stats["per_position_counts"]["g"] == [0, 0, 2]
    assert made["count_oligos"] == {"AC": 2}


def test_joined_sequence(reads_of):
    r = extract.regions(reads_of(("a", "ACGTAC")), [Region("read1", 0, 2), Region("read1", 3, 2)], "x")
    assert r.df.select(joined_sequence(tag("x"), "_")).first()[0] == "AC_TA"
