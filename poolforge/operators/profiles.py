"""Positional profiles of reads in long form: one row for each round, side, position and base.

Profiles count reads, but equal reads are grouped first, and their number is the weight, so the explosion by position works
on unique sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import ADAPTERS, canonical, gc_fraction, has_adapter, kmers

MIN_COVERED = 500


def base_counts(counts: DataFrame, length: int, from_end: bool = False, weight: Column | None = None, start: int = 0) -> DataFrame:
    """round, pos, base, n for positions [start, start + length) from either edge."""
    w = F.col("reads") if weight is None else weight
    places = F.sequence(F.lit(start), F.least(F.length("seq"), F.lit(start + length)) - 1)
    rows = counts.where(F.length("seq") > start).select("round", "seq", w.alias("w"), F.explode(places).alias("pos"))
    at = F.length("seq") - F.col("pos") if from_end else F.col("pos") + 1
    return rows.select("round", "pos", F.substring("seq", at, F.lit(1)).alias("base"), "w").groupBy("round", "pos", "base").agg(F.sum("w").alias("n"))


def consensus(profile: DataFrame, min_covered: int = MIN_COVERED) -> DataFrame:
    """round, pos, base and support (its share) of each position that enough reads reach; ties go to the smaller base."""
    best = profile.groupBy("round", "pos").agg(F.sum("n").alias("covered"), F.max(F.struct("n", F.expr("-ascii(base)").alias("b"))).alias("top"))
    best = best.where(F.col("covered") >= min_covered)
    return best.select("round", "pos", F.chr(-F.col("top.b")).alias("base"), (F.col("top.n") / F.col("covered")).alias("support"), "covered")


def base_fractions(profile: DataFrame, suspect: float = 0.40) -> DataFrame:
    """round, pos, shares of A, C, G, T and N, the top share, and whether the position looks constant."""
    wide = profile.groupBy("round", "pos").pivot("base", ["A", "C", "G", "T", "N"]).agg(F.sum("n")).na.fill(0)
    total = profile.groupBy("round", "pos").agg(F.sum("n").alias("all"))
    letters = ["A", "C", "G", "T", "N"]
    shares = [(F.col(b) / F.col("all")).alias(f"f_{b.lower()}") for b in letters]
    out = wide.join(total, ["round", "pos"]).select("round", "pos", *shares)
    return out.withColumn("top", F.greatest(*[f"f_{b.lower()}" for b in letters])).withColumn("constant_suspect", F.col("top") > suspect)


def positional_entropy(profile: DataFrame) -> DataFrame:
    """round, pos, the top base's share and the entropy in bits."""
    total = profile.groupBy("round", "pos").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    return profile.join(total, ["round", "pos"]).groupBy("round", "pos").agg(F.max(share).alias("top"), F.round(-F.sum(share * F.log2(share)), 9).alias("bits"))


def gc_stats(counts: DataFrame) -> DataFrame:
    """Mean and population deviation of the GC share of non-empty unique sequences."""
    gc = gc_fraction(F.col("seq"))
    return counts.where(F.length("seq") > 0).groupBy("round").agg(F.round(F.avg(gc), 9).alias("gc_mean"), F.round(F.stddev_pop(gc), 9).alias("gc_sd"))


def kmer_weights(counts: DataFrame, k: int, canon: bool = False) -> DataFrame:
    """round, kmer and weight (reads times occurrences)."""
    one = canonical(F.col("kmer")) if canon else F.col("kmer")
    return counts.select("round", "reads", F.explode(kmers(F.col("seq"), k)).alias("kmer")).select("round", "reads", one.alias("kmer")).groupBy("round", "kmer").agg(F.sum("reads").alias("weight"))


def top_kmers(counts: DataFrame, k: int, n: int) -> DataFrame:
    """The heaviest k-mers of each round with their share of all k-mer weight."""
    weights = kmer_weights(counts, k)
    total = weights.groupBy("round").agg(F.sum("weight").alias("all"))
    order = Window.partitionBy("round").orderBy(F.desc("weight"), "kmer")
    best = weights.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return best.join(total, "round").select("round", "place", "kmer", "weight", (F.col("weight") / F.col("all")).alias("share"))


def adapter_hits(reads: DataFrame) -> DataFrame:
    """round, adapter and how many reads hold it, either way round; a read counts once for each adapter."""
    hits = [F.struct(F.lit(a).alias("adapter"), has_adapter(F.col("seq"), a).alias("hit")) for a in sorted(ADAPTERS)]
    return reads.select("round", F.explode(F.array(*hits)).alias("h")).groupBy("round", "h.adapter").agg(F.count_if("h.hit").alias("hits"))


def contamination(counts: DataFrame, adapter: str = "TRUSEQ_R1") -> DataFrame:
    """Shares of unique sequences and of reads that hold an adapter, and those reads."""
    hit = F.contains("seq", F.lit(ADAPTERS[adapter]))
    reads = F.sum(F.when(hit, F.col("reads")).otherwise(0))
    return counts.groupBy("round").agg(F.avg(hit.cast("double")).alias("unique_share"), (reads / F.sum("reads")).alias("read_share"), reads.alias("hit_reads"))


def alphabet_violations(counts: DataFrame) -> DataFrame:
    """Unique sequences with a letter other than A, C, G and T, and their share."""
    bad = F.col("seq").rlike("[^ACGT]")
    return counts.groupBy("round").agg(F.count_if(bad).alias("n_bad"), F.avg(bad.cast("double")).alias("bad_share"))


def read_audit(reads: DataFrame, n: int = 2000) -> DataFrame:
    """Of the first n records of each round: how many, mean length, shortest and longest."""
    order = Window.partitionBy("round").orderBy("rec")
    head = reads.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    size = F.length("seq")
    return head.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_length"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def weighted_median_length(counts: DataFrame) -> DataFrame:
    """The length at which half of a round's reads are reached; works on the short histogram of lengths."""
    by = counts.groupBy("round", F.length("seq").alias("len")).agg(F.sum("reads").alias("n"))
    window = Window.partitionBy("round").orderBy("len")
    total = Window.partitionBy("round")
    reached = by.withColumn("cum", F.sum("n").over(window)).withColumn("all", F.sum("n").over(total))
    return reached.where(F.col("cum") >= (F.col("all") + 1) / 2).groupBy("round").agg(F.min("len").alias("median_length"))
