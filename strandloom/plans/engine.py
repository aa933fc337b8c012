"""Runs a checked pipeline: sources, a fold of its steps, then the sinks and side outputs."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.model import ConfigError, Reads, name, qual, seq
from strandloom.operators.demultiplex import NO_BARCODE
from strandloom.operators.reports import assembled
from strandloom.plans.config import Plan, parse
from strandloom.plans.steps import STEPS, Context
from strandloom.sources import readers, writers

VERSION = "0.1"


def placed(base: str, path: str) -> str:
    return path if "://" in path or os.path.isabs(path) else os.path.join(base, path)


#: The name of a file that stands for the standard input.
STDIN = "--stdin--"


def spooled() -> str:
    """A file with what the standard input holds; on the driver's machine, so for a local master only."""
    with tempfile.NamedTemporaryFile(prefix="strandloom-", delete=False) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    atexit.register(os.unlink, f.name)
    return f.name


def opened(spark: SparkSession, plan: Plan, base: str) -> Reads:
    """The input's molecules."""
    if any(STDIN in paths for paths in plan.segments.values()) and (len(plan.segments) > 1 or list(plan.segments.values()) != [[STDIN]]):
        raise ConfigError("the standard input is the only file of the only segment, or none")
    frames = {s: readers.read_file(spark, [spooled() if p == STDIN else placed(base, p) for p in paths], plan.input_options) for s, paths in plan.segments.items()}
    if plan.interleaved:
        return readers.interleaved(next(iter(frames.values())), plan.interleaved)
    if len(frames) == 1:
        s, df = next(iter(frames.items()))
        return readers.one_segment(df, s)
    return readers.zipped(frames)


def planned(spark: SparkSession, plan: Plan, reads: Reads, base: str = ".") -> Reads:
    """The reads after all steps, with the side outputs the steps asked for; nothing is computed yet."""

    def side(paths: list[str]) -> DataFrame:
        found = readers.read_file(spark, [placed(base, p) for p in paths], plan.input_options | {"fasta_fake_quality": "I", "bam_include_mapped": True, "bam_include_unmapped": True})
        return found.select("name", "seq")

    context = Context(side, plan.barcodes, (plan.output or {}).get("ix_separator", "_"))
    reads = Reads(reads.df, reads.segments, comment=plan.input_options.get("read_comment_character", " "))
    for action, options in plan.steps:
        reads = STEPS[action].run(reads, options, context)
    return reads


def group_names(plan: Plan, reads: Reads, separator: str) -> list[str]:
    """Names of groups that may occur, from the Demultiplex steps; an empty list: no demultiplexing."""
    names = [""] if reads.demux else []
    for action, o in plan.steps:
        if action == "Demultiplex":
            if o["barcodes"] is None:
                own = [f"{o['in_label']}=false", f"{o['in_label']}=true"]
            else:
                own = list(dict.fromkeys(plan.barcodes[o["barcodes"]].values())) + ([NO_BARCODE] if o["output_unmatched"] else [])
            names = [f"{a}{separator}{b}" if a else b for a in names for b in own]
    return names


def one(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col("_demux") == group) if group else df


def run(spark: SparkSession, toml: str, base: str = ".", allow_overwrite: bool = False) -> Reads:
    """Runs a pipeline's text; files are relative to base.  Gives the reads after the last step."""
    began = time.time()
    plan = parse(toml)
    reads = planned(spark, plan, opened(spark, plan, base), base)
    o = plan.output
    if o is None:
        raise ConfigError("the section output is missing")
    separator = o.get("ix_separator", "_")
    prefix = placed(base, o["prefix"])
    kind = o.get("format", "fastq").lower()
    compression, level = o.get("compression", "raw").lower(), o.get("compression_level")
    hashes = {"hash_raw": bool(o.get("output_hash_uncompressed")), "hash_compressed": bool(o.get("output_hash_compressed"))}
    groups = group_names(plan, reads, separator) or [""]
    marker = f"{prefix}.incompleted"
    if o.get("stdout"):
        if o.get("output") or o.get("chunksize") or kind == "bam":
            raise ConfigError("stdout takes neither output, chunksize nor BAM")
        wanted = {}
        rows = records(reads.df, list(o["interleave"]) if isinstance(o.get("interleave"), list) else list(reads.segments))
        for r in rows.orderBy("read_no", "place").select(writers.record_text(kind).alias("value")).toLocalIterator(prefetchPartitions=True):
            print(r["value"])
    else:
        wanted = {} if kind == "none" else sequence_files(o, reads, prefix, kind, compression, groups, separator)
    os.makedirs(os.path.dirname(prefix) or ".", exist_ok=True)
    if not allow_overwrite:
        chunks = [chunk_name(p, "[0-9]*") for p in wanted] if o.get("chunksize") else []
        writers.claim([*(() if chunks else wanted), *side_files(reads, prefix, groups, separator, kind, o)], marker, chunks)
    # a frame that several sinks read is computed once
    shared = reads.df.persist() if len(wanted) > 1 else reads.df
    for path, (group, segments) in wanted.items():
        write_sequences(one(shared, group), path, segments, kind, compression, level, hashes, o.get("chunksize"))
    if len(wanted) > 1:
        shared.unpersist()
    write_sides(reads, plan, prefix, groups, separator, kind, began, o)
    if os.path.exists(marker):
        os.remove(marker)
    return reads


def sequence_files(o: dict, reads: Reads, prefix: str, kind: str, compression: str, groups: list[str], separator: str) -> dict[str, tuple[str, list[str]]]:
    """path -> (group, segments in a record's order) of each file of reads."""
    woven = o.get("interleave", [])
    woven = list(reads.segments) if woven is True else woven or []
    alone = o.get("output", [] if woven else list(reads.segments))
    if woven and len(woven) < 2:
        raise ConfigError("interleave needs two segments at least")
    if set(woven) & set(alone):
        raise ConfigError("a segment is in both output and interleave")
    for s in (*woven, *alone):
        if s not in reads.segments:
            raise ConfigError(f"unknown segment '{s}'")
    suffix = o.get("suffix", writers.SUFFIXES[kind]) if kind in writers.SUFFIXES else None
    if suffix is None:
        raise ConfigError(f"unknown format '{kind}'")
    out = {}
    for g in groups:
        for s in alone:
            out[writers.file_name(prefix, [g, s], suffix, compression, separator)] = (g, [s])
        if woven:
            out[writers.file_name(prefix, [g, "interleaved"], suffix, compression, separator)] = (g, woven)
    return out


def records(df: DataFrame, segments: list[str]) -> DataFrame:
    """(read_no, place, name, seq, qual) of segments one after another."""
    each = F.posexplode(F.array(*(F.struct(name(s).alias("name"), seq(s).alias("seq"), qual(s).alias("qual")) for s in segments))).alias("place", "r")
    return df.select("read_no", each).select("read_no", "place", "r.*")


def write_sequences(df: DataFrame, path: str, segments: list[str], kind: str, compression: str, level: int | None, hashes: dict, chunk: int | None) -> None:
    rows = records(df, segments)
    if not chunk:
        writers.write_reads(rows, path, kind, compression, level, segments=len(segments), order="read_no,place", **hashes)
        return
    from strandloom.model import ordered_rank

    ranked = ordered_rank(df.select("read_no"), [], "_rank").select("read_no", F.floor((F.col("_rank") - 1) / chunk).alias("_chunk"))
    count = ranked.agg(F.max("_chunk")).first()[0]
    digits = len(str(count or 0))
    dealt = rows.join(ranked, "read_no")
    for k in range((count if count is not None else 0) + 1):
        writers.write_reads(dealt.where(F.col("_chunk") == k), chunk_name(path, f"{k:0{digits}d}"), kind, compression, level, segments=len(segments), order="read_no,place", **hashes)


def chunk_name(path: str, number: str) -> str:
    stem, _, rest = path.rpartition("/")
    base, dot, suffix = rest.partition(".")
    return os.path.join(stem, f"{base}.{number}{dot}{suffix}")


def inspected_file(s, prefix: str, separator: str, kind: str) -> tuple[str, str]:
    """The path and the format of an inspection."""
    shape = s.details.get("format") or (kind if kind in ("fastq", "fasta") else "fastq")
    label = "interleaved" if s.details["interleaved"] and len(s.details["segments"]) > 1 else s.details["segments"][0]
    return writers.file_name(prefix, [s.name, label], s.details.get("suffix") or writers.SUFFIXES[shape], s.details.get("compression", "raw"), separator), shape


def tag_file(s, prefix: str, group: str, separator: str) -> str:
    shape = s.details.get("format") or "fastq"
    return writers.file_name(prefix, [f"tag.{s.name}", group], writers.SUFFIXES[shape], s.details.get("compression", "raw"), separator)


def side_files(reads: Reads, prefix: str, groups: list[str], separator: str, kind: str, o: dict) -> list[str]:
    """The paths that write_sides will write."""
    out = [f"{prefix}.{x}" for x in ("json", "html") if o.get(f"report_{x}")]
    for s in reads.outputs:
        own = groups if "_demux" in s.df.columns else [""]
        if s.kind == "inspect":
            out.append(inspected_file(s, prefix, separator, kind)[0])
        elif s.kind == "progress" and s.name:
            out.append(f"{prefix}{separator}{s.name}.progress")
        elif s.kind == "table":
            out += [writers.file_name(prefix, [s.name, g], "tsv", s.details.get("compression", "raw"), separator) for g in own]
        elif s.kind == "tag reads":
            out += [tag_file(s, prefix, g, separator) for g in own]
        elif s.kind == "counts":
            out += [writers.file_name(prefix, [s.name, g], "qr.json", "raw", separator) for g in own]
    return out


def write_sides(reads: Reads, plan: Plan, prefix: str, groups: list[str], separator: str, kind: str, began: float, o: dict) -> None:
    """Tables, counts, tag reads, inspected reads, progress and reports."""
    parts: dict[str, list] = {}
    for s in reads.outputs:
        grouped = "_demux" in s.df.columns
        if s.kind == "report":
            parts.setdefault(s.name, []).append((s.details, s.df.collect()))  # sums, not rows of the input
        elif s.kind == "inspect":
            for segments in [list(s.details["segments"])]:
                rows = s.df
                if s.details["demux"]:
                    rows = rows.withColumns({x: F.struct(F.concat(name(x), F.lit(" Demultiplex="), F.coalesce("_demux", F.lit(""))).alias("name"), seq(x).alias("seq"), qual(x).alias("qual")) for x in segments})
                path, shape = inspected_file(s, prefix, separator, kind)
                writers.write_reads(records(rows, segments), path, shape, s.details.get("compression", "raw"), order="read_no,place")
        elif s.kind == "matched":
            if not s.df.first()["matched"]:
                raise ValueError(f"Demultiplex by '{s.name}': no molecule has any of the barcodes")
        elif s.kind == "progress":
            r = s.df.first()
            text = f"{r['molecules']} molecules in {time.time() - began:.1f} s\n"
            if s.name:
                with open(f"{prefix}{separator}{s.name}.progress", "w") as f:
                    f.write(text)
            else:
                print(text, end="")
        else:
            for g in groups if grouped else [""]:
                rows = one(s.df, g)
                if s.kind == "table":
                    compression = s.details.get("compression", "raw")
                    writers.write_table(rows, s.details["columns"], writers.file_name(prefix, [s.name, g], "tsv", compression, separator), compression)
                elif s.kind == "tag reads":
                    writers.write_reads(rows, tag_file(s, prefix, g, separator), s.details.get("format") or "fastq", s.details.get("compression", "raw"))
                elif s.kind == "counts":
                    found = {r["key"]: r["count"] for r in rows.orderBy(F.desc("count"), F.lower("key")).toLocalIterator()}
                    with open(writers.file_name(prefix, [s.name, g], "qr.json", "raw", separator), "w") as f:
                        json.dump(found, f, indent=2)
    made = {n: assembled(p) for n, p in parts.items()}
    if o.get("report_json") or o.get("report_html"):
        text = json.dumps({"__": {"version": VERSION}, **made, "run_info": {"seconds": round(time.time() - began, 1)}, "report_order": list(made)}, indent=2)
        if o.get("report_json"):
            with open(f"{prefix}.json", "w") as f:
                f.write(text)
        if o.get("report_html"):
            with open(f"{prefix}.html", "w") as f:
                f.write("<!doctype html><meta charset=utf-8><title>Report</title><pre id=r></pre><script>const report=" + text.replace("</", "<\\/") + ";r.textContent=JSON.stringify(report,null,2)</script>\n")


def validate(toml: str) -> Plan:
    """Checks a pipeline's text without opening any file."""
    return parse(toml)
