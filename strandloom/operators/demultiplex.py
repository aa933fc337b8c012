"""Demultiplexing: molecules get the name of their barcode; later steps that keep state keep it per name."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.dna import iupac_overlap, iupac_regex
from strandloom.model import ConfigError, Reads, SideOutput, TagType, joined_sequence, tag

NO_BARCODE = "no-barcode"


def check_barcodes(barcodes: dict[str, str]) -> None:
    """Barcodes are of one length, and those of different names fit no common sequence."""
    if not barcodes:
        raise ConfigError("there are no barcodes")
    if len({len(b) for b in barcodes}) > 1:
        raise ConfigError("barcodes differ in length")
    known = list(barcodes.items())
    for k, (a, x) in enumerate(known):
        for b, y in known[:k]:
            if x != y and iupac_overlap(a.replace("_", ""), b.replace("_", "")):
                raise ConfigError(f"barcodes {a} and {b} overlap but have different names")


def demultiplex(reads: Reads, label: str, barcodes: dict[str, str] | None = None, output_unmatched: bool | None = None, separator: str = "_") -> Reads:
    """Names of groups from a tag: by barcode (equal, or else fitting as IUPAC, in the barcodes' order), or by a Bool tag's value.

    Several steps combine their names.  A molecule without a name in one of
    them has none, and is dropped by the sinks.  That no molecule at all has a
    barcode is an error, which the run finds at its end.
    """
    kind = reads.tags.get(label)
    if kind is None or kind is TagType.NUMERIC:
        raise ConfigError(f"tag '{label}' can't be demultiplexed by")
    if barcodes is None:
        if kind is not TagType.BOOL:
            raise ConfigError("barcodes are needed for tags that aren't Bool")
        found = F.concat(F.lit(f"{label}="), F.coalesce(tag(label), F.lit(False)).cast("string"))
    else:
        if kind is TagType.BOOL or output_unmatched is None:
            raise ConfigError("barcodes are for Location and String tags, and need output_unmatched")
        check_barcodes(barcodes)
        text = joined_sequence(tag(label), "_") if kind is TagType.LOCATION else tag(label)
        found = F.when(F.lit(False), F.lit(""))
        for b, n in barcodes.items():
            found = found.when(text == b, F.lit(n))
        for b, n in sorted(barcodes.items()):
            if set(b.upper()) - set("ACGT_"):
                found = found.when((F.length(text) == len(b)) & F.regexp_like(text, F.lit(iupac_regex(b.replace("_", "N")) + "$")), F.lit(n))
        found = found.otherwise(F.lit(NO_BARCODE) if output_unmatched else F.lit(None))
    if barcodes is not None:
        matched = F.max(F.coalesce(found != NO_BARCODE, F.lit(False))).alias("matched")
        reads = reads.with_output(SideOutput("matched", label, reads.df.agg(F.coalesce(matched, F.lit(False)).alias("matched"))))
    new = F.when(F.col("_demux").isNotNull() & found.isNotNull(), F.concat("_demux", F.lit(separator), found)) if reads.demux else found
    return reads.with_df(reads.df.withColumn("_demux", new), demux=(*reads.demux, label))
