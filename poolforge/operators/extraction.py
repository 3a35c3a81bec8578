"""Extraction of inserts as a library report says, merging of a round's inputs, and counts of a tree of rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import rc
from .counts import unique_counts
from .trimming import demultiplexed, linked_trim, paired_trim, reoriented

# Extraction modes whose output is a countable insert, and the one whose reads cover it in parts.
COUNTABLE_MODES = ("BOTH_PRIMERS_SINGLE_READ", "FIVE_PRIME_ONLY", "THREE_PRIME_ONLY")
SPLIT_MODE = "PAIRED_END_SPLIT_PRIMERS"
UNABLE_STATUS, UNABLE_MODE = "UNABLE_TO_INFER", "UNABLE_TO_EXTRACT"


def countable(mode: Column) -> Column:
    """Whether a mode's output is counted; a null mode and the split one are not."""
    return F.coalesce(mode, F.lit("")).isin(*COUNTABLE_MODES)


def refused(status: Column, mode: Column) -> Column:
    """Whether a report refuses extraction, by its status or by its mode; nulls do not refuse."""
    return F.coalesce(status == UNABLE_STATUS, F.lit(False)) | F.coalesce(mode == UNABLE_MODE, F.lit(False))


def overridden(report: dict, five: str | None, three: str | None) -> dict:
    """report with the primers given in place of its own; the mode follows from which of them are given."""
    if not five and not three:
        return report
    mode = "BOTH_PRIMERS_SINGLE_READ" if five and three else "FIVE_PRIME_ONLY" if five else "THREE_PRIME_ONLY"
    return {**report, "primer_5p": five, "primer_3p": three, "extraction_mode": mode, "status": "OVERRIDDEN", "orientation": report.get("orientation", "FORWARD")}


def merged_inputs(parts: DataFrame) -> DataFrame:
    """parts (round, file, rec, ...) with rec as the place in the round when its files follow one another by name.

    Each file is moved by the records of the files before it, one row a file, so that no round is numbered in one task.
    Places keep the order of the inputs; records that are missing in a file leave gaps.
    """
    sizes = parts.groupBy("round", "file").agg((F.max("rec") + 1).alias("size"))
    before = Window.partitionBy("round").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("round", "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    placed = parts.join(moved, ["round", "file"])
    return placed.select(*[(F.col("rec") + F.col("__before")).alias("rec") if c == "rec" else F.col(f"`{c}`") for c in parts.columns])


@dataclass
class Extraction:
    """Trimmed reads and the yield of each round, or why there are none."""

    mode: str | None
    skipped_reason: str | None = None
    reads: DataFrame | None = None
    yields: DataFrame | None = None


def run_extract(reads: DataFrame, report: dict, barcodes: list[tuple[str, int]] | None = None, five: str | None = None, three: str | None = None) -> Extraction:
    """Reads trimmed as a report says: override, refusal, demultiplexing, orientation, trimming, yields, in this order.

    reads: seq, round unless barcodes are given, and mate_seq for the split mode. report: primer_5p, primer_3p, extraction_mode,
    status and orientation. Reads whose barcode is unknown are left out. A round of which nothing is left has a yield of 0.
    """
    report = overridden(report, five, three)
    mode = report.get("extraction_mode")
    if report.get("status") == UNABLE_STATUS or mode == UNABLE_MODE:
        return Extraction(mode, f"report refuses extraction: {report.get('status')}, {mode}")
    if mode not in (*COUNTABLE_MODES, SPLIT_MODE):
        return Extraction(mode, f"unknown extraction mode: {mode}")
    if mode == SPLIT_MODE and "mate_seq" not in reads.columns:
        return Extraction(mode, "split primers need both reads of a pair")
    if barcodes:
        reads = demultiplexed(reads, barcodes).where(F.col("round").isNotNull())
    if report.get("orientation") == "REVERSE" and mode != SPLIT_MODE:
        reads = reoriented(reads)
    if mode == SPLIT_MODE:
        trimmed = paired_trim(reads, report["primer_5p"], rc(report["primer_3p"]))
    else:
        trimmed = linked_trim(reads, None if mode == "THREE_PRIME_ONLY" else report["primer_5p"], None if mode == "FIVE_PRIME_ONLY" else report["primer_3p"])
    return Extraction(mode, None, trimmed, extraction_yields(reads, trimmed))


def extraction_yields(reads: DataFrame, trimmed: DataFrame) -> DataFrame:
    """round, n_in, n_out and share of the reads that trimming leaves."""
    n_in = reads.groupBy("round").agg(F.count(F.lit(1)).alias("n_in"))
    n_out = trimmed.groupBy("round").agg(F.count(F.lit(1)).alias("n_out"))
    both = n_in.join(n_out, "round", "left").na.fill(0, ["n_out"])
    return both.withColumn("share", F.col("n_out") / F.col("n_in"))


def tree_counts(placed: DataFrame) -> DataFrame:
    """target, label, round, seq and reads of placed reads (sources.trees); empty reads are left out."""
    return unique_counts(placed.where(F.length("seq") > 0), "target", "label", "round", "seq")


def tree_stats(counts: DataFrame) -> DataFrame:
    """One row for each target and round of tree_counts: reads, uniques, the most frequent, singletons."""
    return counts.groupBy("target", "label", "round").agg(
        F.sum("reads").alias("n_reads"),
        F.count(F.lit(1)).alias("n_unique"),
        F.max("reads").alias("top_reads"),
        (F.max("reads") / F.sum("reads")).alias("top1_share"),
        F.count_if(F.col("reads") == 1).alias("n_singletons"),
    )
