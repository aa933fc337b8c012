"""The steps a pipeline can name: their options, other names and defaults, and the operator each stands for."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from strandloom.model import ConfigError, Reads
from strandloom.operators import calc, demultiplex, edits, extract, filters, reports, tags, validate
from strandloom.sources.writers import COMPRESSIONS, SUFFIXES

#: A step's option without a default.
NEEDED = object()


@dataclass(frozen=True)
class Context:
    """What steps need beside the reads."""

    read_side: Callable[[list[str]], object]  # (name, seq) of another file
    barcodes: dict[str, dict[str, str]]
    separator: str = "_"


@dataclass(frozen=True)
class Step:
    """An action with its options by name; each option is (default, other names)."""

    options: dict[str, tuple]
    run: Callable[[Reads, dict, Context], Reads]
    segment_default: str | None = None  # for steps where a missing segment is not the only one


STEPS: dict[str, Step] = {}
ALIASES: dict[str, str] = {}


def option(default=NEEDED, *names: str) -> tuple:
    return default, names


SEGMENT = option(None)
IF = {"if_tag": option(None)}


def step(action: str, *aliases: str, **options):
    def put(run):
        STEPS[action] = Step(options, run)
        for a in (action, *aliases):
            ALIASES[a.lower().replace("_", "")] = action
        return run

    return put


def only(reads: Reads, segment: str | None, allow_all: bool = False) -> str:
    """A segment's name; a missing one is the only one."""
    if segment is None:
        if len(reads.segments) == 1:
            return reads.segments[0]
        raise ConfigError("segment is needed, there are several")
    if segment.lower() == "all" and allow_all:
        return "all"
    found = next((s for s in reads.segments if s.lower() == segment.lower()), None)
    if found is None:
        raise ConfigError(f"unknown segment '{segment}'")
    return found


def source(reads: Reads, text: str | None, allow_all: bool = True) -> str:
    """A segment, all, tag:<label> or name:<segment>, resolved."""
    if text is not None and text.startswith("tag:"):
        if text[4:] not in reads.tags:
            raise ConfigError(f"unknown tag '{text[4:]}'")
        return text
    if text is not None and text.startswith("name:"):
        return "name:" + only(reads, text[5:], allow_all)
    return only(reads, text, allow_all)


def known(reads: Reads, label: str) -> str:
    if label not in reads.tags:
        raise ConfigError(f"unknown tag '{label}'")
    return label


def listed(value) -> list:
    return value if isinstance(value, list) else [value]


def byte(value) -> int:
    """A byte as a number or a character."""
    b = ord(value) if isinstance(value, str) and len(value) == 1 else value
    if not isinstance(b, int) or not 0 <= b <= 255:
        raise ConfigError(f"{value!r} is not a byte")
    return b


def positive(value: int, name: str = "n") -> int:
    if not isinstance(value, int) or value <= 0:
        raise ConfigError(f"{name} must be a positive integer")
    return value


def condition(reads: Reads, o: dict) -> str | None:
    if o.get("if_tag") is not None:
        known(reads, o["if_tag"].removeprefix("!"))
    return o.get("if_tag")


def told(reads: Reads, o: dict) -> Reads:
    """The reads, whose last side output knows how its file is to be written."""
    how = {k: o[k].lower() if k != "suffix" else o[k] for k in ("compression", "format", "suffix") if o.get(k)}
    if how.get("compression", "raw") not in COMPRESSIONS:
        raise ConfigError(f"unknown compression '{how['compression']}'")
    if how.get("format", "fastq") not in SUFFIXES:
        raise ConfigError(f"unknown format '{how['format']}'")
    *others, last = reads.outputs
    return replace(reads, outputs=(*others, replace(last, details=last.details | how)))


def iupac_text(value: str) -> str:
    if not value or re.search(r"[^ATUCGRYSWKMBVDHN]", value.upper()):
        raise ConfigError(f"{value!r} is not a IUPAC pattern")
    return value


def anchor(value: str, names: dict[str, str]) -> str:
    try:
        return names[value.lower()]
    except KeyError:
        raise ConfigError(f"unknown anchor '{value}'") from None


ENDS = {"left": "left", "right": "right", "anywhere": "anywhere"}
SIDES = {"start": "start", "left": "start", "end": "end", "right": "end"}

# edits

step("CutStart", segment=SEGMENT, n=option(), **IF)(lambda r, o, c: edits.cut_start(r, only(r, o["segment"]), positive(o["n"]), condition(r, o)))
step("CutEnd", segment=SEGMENT, n=option(), **IF)(lambda r, o, c: edits.cut_end(r, only(r, o["segment"]), positive(o["n"]), condition(r, o)))
step("Truncate", segment=SEGMENT, n=option(), **IF)(lambda r, o, c: edits.truncate(r, only(r, o["segment"]), o["n"], condition(r, o)))


def _extended(make):
    def run(r: Reads, o: dict, c: Context) -> Reads:
        if re.search("[^ACGTN]", o["seq"].upper()):
            raise ConfigError("seq may have A, C, G, T and N")
        edits.encoding(o["encoding"])
        return make(r, only(r, o["segment"]), o["seq"], o["qual"], condition(r, o))

    return run


for _name, _make in (("Prefix", edits.prefix), ("Postfix", edits.postfix)):
    step(_name, segment=SEGMENT, seq=option(), qual=option(), encoding=option("Sanger"), **IF)(_extended(_make))
step("ReverseComplement", segment=SEGMENT, **IF)(lambda r, o, c: edits.reverse_complement_step(r, only(r, o["segment"]), condition(r, o)))
step("ConvertQuality", **{"from": option(), "to": option()})(lambda r, o, c: edits.convert_quality(r, o["from"], o["to"]))
step("Rename", search=option(NEEDED, "query", "pattern"), replacement=option())(lambda r, o, c: edits.rename(r, o["search"], extract.java_replacement(o["replacement"])))


@step("Swap", segment_a=option(None), segment_b=option(None), **IF)
def _swap(r: Reads, o: dict, c: Context) -> Reads:
    if o["segment_a"] is None and o["segment_b"] is None and len(r.segments) == 2:
        return edits.swap(r, *r.segments, condition(r, o))
    return edits.swap(r, only(r, o["segment_a"]), only(r, o["segment_b"]), condition(r, o))


step("Lowercase", target=option(None, "segment", "source"), **IF)(lambda r, o, c: edits.change_case(r, source(r, o["target"]), False, condition(r, o)))
step("Uppercase", target=option(None, "segment", "source"), **IF)(lambda r, o, c: edits.change_case(r, source(r, o["target"]), True, condition(r, o)))
step("TrimAtTag", in_label=option(), direction=option(), keep_tag=option())(lambda r, o, c: edits.trim_at_tag(r, known(r, o["in_label"]), anchor(o["direction"], SIDES), o["keep_tag"]))


@step("MergeReads", algorithm=option(), segment1=option(None), segment2=option(None), min_overlap=option(), max_mismatch_rate=option(), max_mismatch_count=option(), no_overlap_strategy=option(), reverse_complement_segment2=option(), concatenate_spacer=option(""), spacer_quality_char=option(33), out_label=option(None))
def _merge(r: Reads, o: dict, c: Context) -> Reads:
    if o["algorithm"].lower() not in ("fastp", "fastpseemsweird"):
        raise ConfigError(f"unknown algorithm '{o['algorithm']}'")
    strategy = o["no_overlap_strategy"].lower().replace("_", "")
    if strategy not in ("asis", "concatenate"):
        raise ConfigError("no_overlap_strategy is as_is or concatenate")
    pair = r.segments if o["segment1"] is None and len(r.segments) == 2 else (only(r, o["segment1"]), only(r, o["segment2"]))
    return edits.merge(r, *pair, o["min_overlap"], o["max_mismatch_rate"], o["max_mismatch_count"], strategy, o["reverse_complement_segment2"], o["concatenate_spacer"], byte(o["spacer_quality_char"]), o["out_label"])


step("StoreTagInSequence", in_label=option(), ignore_missing=option(False))(lambda r, o, c: edits.store_tag_in_sequence(r, known(r, o["in_label"]), o["ignore_missing"]))
step("ReplaceTagWithLetter", in_label=option(), letter=option())(lambda r, o, c: edits.replace_tag_with_letter(r, known(r, o["in_label"]), chr(byte(o["letter"]))))
COMMENTS = {"comment_separator": option("|"), "comment_insert_char": option(" ")}
step("StoreTagInComment", in_label=option(), segment=option("all"), region_separator=option("_"), **COMMENTS)(lambda r, o, c: edits.store_tag_in_comment(r, known(r, o["in_label"]), only(r, o["segment"], True), chr(byte(o["comment_separator"])), chr(byte(o["comment_insert_char"])), o["region_separator"]))
step("StoreTagLocationInComment", in_label=option(), segment=option("all"), **COMMENTS)(lambda r, o, c: edits.store_tag_location_in_comment(r, known(r, o["in_label"]), only(r, o["segment"], True), chr(byte(o["comment_separator"])), chr(byte(o["comment_insert_char"]))))

# places

SEARCH = option(NEEDED, "query", "pattern")
step("ExtractIUPAC", segment=SEGMENT, search=SEARCH, anchor=option(), max_mismatches=option(), out_label=option())(lambda r, o, c: extract.iupac(r, only(r, o["segment"]), [iupac_text(p) for p in listed(o["search"])], anchor(o["anchor"], ENDS), o["max_mismatches"], o["out_label"]))
step("ExtractIUPACWithIndel", segment=SEGMENT, search=SEARCH, anchor=option(), max_mismatches=option(0), max_indel_bases=option(0), max_total_edits=option(None), out_label=option())(lambda r, o, c: extract.iupac_with_indel(r, only(r, o["segment"]), [iupac_text(p) for p in listed(o["search"])], anchor(o["anchor"], ENDS), o["out_label"], o["max_mismatches"], o["max_indel_bases"], o["max_total_edits"]))
step("ExtractIUPACSuffix", segment=SEGMENT, search=SEARCH, min_length=option(), max_mismatches=option(), out_label=option())(lambda r, o, c: extract.iupac_suffix(r, only(r, o["segment"]), o["search"], o["min_length"], o["max_mismatches"], o["out_label"]))
step("ExtractRegex", source=option(None, "segment"), search=SEARCH, replacement=option("$0"), out_label=option())(lambda r, o, c: extract.regex(r, source(r, o["source"], False), o["search"], o["out_label"], o["replacement"]))


def region(r: Reads, o: dict) -> extract.Region:
    length = o.get("length", o.get("len"))
    if not isinstance(length, int) or length < 1:
        raise ConfigError("a region needs a positive length")
    return extract.Region(source(r, o.get("source", o.get("segment")), False), o["start"], length, anchor(o.get("anchor", "start"), SIDES))


step("ExtractRegion", source=option(None, "segment"), start=option(), len=option(NEEDED, "length"), anchor=option("start"), out_label=option())(lambda r, o, c: extract.regions(r, [region(r, o)], o["out_label"]))
step("ExtractRegions", regions=option(), out_label=option())(lambda r, o, c: extract.regions(r, [region(r, x) for x in o["regions"]], o["out_label"]))
POLY = {"segment": SEGMENT, "base": option(), "min_length": option(), "max_mismatch_rate": option(), "max_consecutive_mismatches": option(), "out_label": option()}
step("ExtractPolyTail", **POLY)(lambda r, o, c: extract.poly_tail(r, only(r, o["segment"]), o["base"].upper(), o["min_length"], o["max_mismatch_rate"], o["max_consecutive_mismatches"], o["out_label"]))
step("ExtractLongestPolyX", **POLY)(lambda r, o, c: extract.longest_poly_x(r, only(r, o["segment"]), o["base"].upper(), o["min_length"], o["max_mismatch_rate"], o["max_consecutive_mismatches"], o["out_label"]))
step("ExtractLowQualityStart", segment=SEGMENT, min_qual=option(NEEDED, "min_quality"), out_label=option())(lambda r, o, c: extract.low_quality_start(r, only(r, o["segment"]), byte(o["min_qual"]), o["out_label"]))
step("ExtractLowQualityEnd", segment=SEGMENT, min_qual=option(NEEDED, "min_quality"), out_label=option())(lambda r, o, c: extract.low_quality_end(r, only(r, o["segment"]), byte(o["min_qual"]), o["out_label"]))
step("ExtractRegionsOfLowQuality", segment=SEGMENT, min_quality=option(NEEDED, "min_qual"), min_length=option(1), out_label=option())(lambda r, o, c: extract.regions_of_low_quality(r, only(r, o["segment"]), byte(o["min_quality"]), positive(o["min_length"], "min_length"), o["out_label"]))

# numbers

step("CalcLength", segment=SEGMENT, out_label=option())(lambda r, o, c: calc.length(r, only(r, o["segment"], True), o["out_label"]))
step("CalcBaseContent", segment=SEGMENT, bases_to_count=option(), bases_to_ignore=option(""), relative=option(True), out_label=option())(lambda r, o, c: calc.base_content(r, only(r, o["segment"], True), o["bases_to_count"], o["out_label"], o["bases_to_ignore"], o["relative"]))
step("CalcGCContent", segment=SEGMENT, out_label=option())(lambda r, o, c: calc.gc_content(r, only(r, o["segment"], True), o["out_label"]))
step("CalcNCount", segment=SEGMENT, out_label=option())(lambda r, o, c: calc.n_count(r, only(r, o["segment"], True), o["out_label"]))
step("CalcComplexity", segment=SEGMENT, out_label=option())(lambda r, o, c: calc.complexity(r, only(r, o["segment"], True), o["out_label"]))
step("CalcQualifiedBases", segment=SEGMENT, threshold=option(), operator=option(NEEDED, "op"), out_label=option())(lambda r, o, c: calc.qualified_bases(r, only(r, o["segment"], True), byte(o["threshold"]), o["operator"], o["out_label"]))
step("CalcExpectedError", segment=option("all"), aggregate=option(), out_label=option())(lambda r, o, c: calc.expected_error(r, only(r, o["segment"], True), o["aggregate"], o["out_label"]))
step("CalcKmers", segment=SEGMENT, filename=option(NEEDED, "filenames", "files"), k=option(), count_reverse_complement=option(NEEDED, "canonical"), min_count=option(1), out_label=option())(lambda r, o, c: calc.kmers(r, only(r, o["segment"], True), c.read_side(listed(o["filename"])), positive(o["k"], "k"), o["count_reverse_complement"], o["out_label"], o["min_count"]))
step("ConvertRegionsToLength", in_label=option(), out_label=option())(lambda r, o, c: calc.regions_to_length(r, known(r, o["in_label"]), o["out_label"]))
step("EvalExpression", "EvaluateExpression", expression=option(NEEDED, "expr"), result_type=option(NEEDED, "output_type"), out_label=option())(lambda r, o, c: calc.eval_expression(r, o["expression"], o["result_type"], o["out_label"]))

# other tags


@step("TagDuplicates", source=option("all", "segment"), false_positive_rate=option(0.0), seed=option(None), out_label=option())
def _duplicates(r: Reads, o: dict, c: Context) -> Reads:
    if o["false_positive_rate"] > 0 and o["seed"] is None:
        raise ConfigError("seed is needed with a false_positive_rate")
    return tags.duplicates(r, source(r, o["source"]), o["out_label"])  # exact: no false positives


@step("TagOtherFile", source=option(None, "segment"), filename=option(NEEDED, "filenames", "files"), false_positive_rate=option(0.0), seed=option(None), other_readname_end_character=option(None, "other_read_name_end_char", "other_readname_end_char"), include_mapped=option(None), include_unmapped=option(None), out_label=option())
def _other(r: Reads, o: dict, c: Context) -> Reads:
    if o["false_positive_rate"] > 0 and o["seed"] is None:
        raise ConfigError("seed is needed with a false_positive_rate")
    what = source(r, o["source"])
    return tags.other_file(r, what, c.read_side(listed(o["filename"])), o["out_label"], what.startswith("name:"), o["other_readname_end_character"])


step("ConcatTags", in_labels=option(), out_label=option(), separator=option(""), on_missing=option("merge_present"))(lambda r, o, c: tags.concat_tags(r, [known(r, x) for x in o["in_labels"]], o["out_label"], o["separator"], o["on_missing"]))
step("HammingCorrect", in_label=option(), out_label=option(), barcodes=option(), max_hamming_distance=option(), on_no_match=option())(lambda r, o, c: tags.hamming_correct(r, known(r, o["in_label"]), o["out_label"], list(barcodes_of(c, o["barcodes"])), o["max_hamming_distance"], o["on_no_match"]))
step("ForgetTag", in_label=option())(lambda r, o, c: tags.forget(r, [o["in_label"]]))
step("ForgetAllTags")(lambda r, o, c: tags.forget(r, None))
step("StoreTagsInTable", infix=option("tags"), in_labels=option(None), compression=option("raw"), region_separator=option("_"))(lambda r, o, c: told(tags.store_in_table(r, o["infix"], o["in_labels"], o["region_separator"]), o))
step("StoreTagInFastQ", in_label=option(), comment_tags=option(None), comment_location_tags=option(None), format=option("fastq"), compression=option("raw"), region_separator=option("_"), **COMMENTS)(lambda r, o, c: told(tags.store_in_fastq(r, known(r, o["in_label"]), o["comment_tags"], o["comment_location_tags"], chr(byte(o["comment_separator"])), chr(byte(o["comment_insert_char"])), o["region_separator"]), o))
step("QuantifyTag", in_label=option(), infix=option(), region_separator=option("_"))(lambda r, o, c: tags.quantify(r, known(r, o["in_label"]), o["infix"], o["region_separator"]))


def barcodes_of(c: Context, name: str) -> dict[str, str]:
    if name not in c.barcodes:
        raise ConfigError(f"there are no barcodes '{name}'")
    return c.barcodes[name]


step("Demultiplex", in_label=option(), barcodes=option(None), output_unmatched=option(None))(lambda r, o, c: demultiplex.demultiplex(r, known(r, o["in_label"]), None if o["barcodes"] is None else barcodes_of(c, o["barcodes"]), o["output_unmatched"], c.separator))

# selections

KEEP = {"keep_or_remove": option()}
step("FilterByTag", in_label=option(), **KEEP)(lambda r, o, c: filters.by_tag(r, known(r, o["in_label"]), o["keep_or_remove"]))
step("FilterByNumericTag", in_label=option(), min_value=option(None), max_value=option(None), **KEEP)(lambda r, o, c: filters.by_numeric_tag(r, known(r, o["in_label"]), o["keep_or_remove"], o["min_value"], o["max_value"]))
step("FilterEmpty", segment=SEGMENT)(lambda r, o, c: filters.empty(r, only(r, o["segment"], True)))
step("Head", n=option())(lambda r, o, c: filters.head(r, o["n"]))
step("Skip", n=option())(lambda r, o, c: filters.skip(r, o["n"]))
step("FilterSample", "sample", p=option(), seed=option())(lambda r, o, c: filters.sample(r, o["p"], o["seed"]))
step("FilterReservoirSample", "reservoirsample", n=option(), seed=option())(lambda r, o, c: filters.reservoir_sample(r, o["n"], o["seed"]))

# checks and reports

step("ValidateSeq", segment=SEGMENT, allowed=option())(lambda r, o, c: validate.sequences(r, only(r, o["segment"], True), o["allowed"]))
step("ValidateQuality", segment=SEGMENT, encoding=option())(lambda r, o, c: validate.qualities(r, only(r, o["segment"], True), o["encoding"]))
step("ValidateName", readname_end_char=option(None), sample_stride=option(1000))(lambda r, o, c: validate.names(r, o["readname_end_char"] and chr(byte(o["readname_end_char"])), o["sample_stride"]))
step("ValidateReadPairing", "SpotCheckReadNames", sample_stride=option(1000))(lambda r, o, c: validate.read_pairing(r, o["sample_stride"]))
step("ValidateAllReadsSameLength", source=option(None, "segment"))(lambda r, o, c: validate.same_length(r, source(r, o["source"])))


@step("Report", name=option(), count=option(True), length_distribution=option(False), duplicate_count_per_read=option(False), duplicate_count_per_fragment=option(False), base_statistics=option(False), count_oligos=option(None), count_oligos_segment=option("all"), tag_histograms=option(None, "tag_histogram"))
def _report(r: Reads, o: dict, c: Context) -> Reads:
    parts = {p for p in reports.PARTS if o[p]}
    return reports.report(r, o["name"], parts, listed(o["count_oligos"] or []), only(r, o["count_oligos_segment"], True), [known(r, x) for x in listed(o["tag_histograms"] or [])])


step("Inspect", n=option(), infix=option(), segment=option(None), suffix=option(None), format=option(None), compression=option("raw"))(lambda r, o, c: told(reports.inspect(r, o["n"], o["infix"], only(r, o["segment"], True)), o))
step("Progress", n=option(1_000_000), output_infix=option(None))(lambda r, o, c: reports.progress(r, positive(o["n"]), o["output_infix"]))
