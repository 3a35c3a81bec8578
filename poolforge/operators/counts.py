"""Counts of unique sequences by round, their ranks, and what they say of a round's diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_counts(reads: DataFrame, *keys: str) -> DataFrame:
    """reads of each sequence by round; partial counts are combined before the shuffle."""
    return reads.groupBy(*(keys or ("round", "seq"))).agg(F.count(F.lit(1)).alias("reads"))


def counted(reads: DataFrame) -> DataFrame:
    """Counts as they are, reads counted."""
    return reads if "reads" in reads.columns else unique_counts(reads)


def round_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("round").agg(F.sum("reads").alias("total"))


def with_totals(counts: DataFrame) -> DataFrame:
    """counts with their round's total, by a join with one row for each round, not by a window over the round."""
    return counts.join(round_totals(counts), "round")


def with_rpm(counts: DataFrame) -> DataFrame:
    return with_totals(counts).withColumn("rpm", F.col("reads") * 1e6 / F.col("total")).drop("total")


def ranked(counts: DataFrame) -> DataFrame:
    """rank by reads, ties by sequence. A full ranking orders a whole round; top() does with less."""
    order = Window.partitionBy("round").orderBy(F.desc("reads"), "seq")
    return counts.withColumn("rank", F.row_number().over(order))


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent sequences of each round, ranked; each task keeps n a round before the shuffle."""
    return ranked(counts).where(F.col("rank") <= n)


def entropy(share: Column) -> Column:
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


def cached_stats(counts: DataFrame) -> DataFrame:
    """Statistics of counts that were written before: as round_stats(), but without entropy (NaN) or mark of a trim (null)."""
    return (
        counts.groupBy("round")
        .agg(
            F.sum("reads").alias("n_reads"),
            F.count(F.lit(1)).alias("n_unique"),
            F.max("reads").alias("top_reads"),
            F.count_if(F.col("reads") == 1).alias("n_singletons"),
            F.count_if(F.col("reads") >= 10).alias("n_ge_10"),
            F.count_if(F.col("reads") >= 100).alias("n_ge_100"),
        )
        .select(
            "*",
            (F.col("top_reads") * 1e6 / F.col("n_reads")).alias("top_rpm"),
            (F.col("top_reads") / F.col("n_reads")).alias("top1_share"),
            (F.col("n_singletons") / F.col("n_unique")).alias("singleton_share"),
            F.lit(float("nan")).alias("shannon_bits"),
            F.lit(None).cast("boolean").alias("trimmed"),
        )
    )


def round_stats(counts: DataFrame) -> DataFrame:
    """One row for each round with the count statistics."""
    share = F.col("reads") / F.col("total")
    return (
        with_totals(counts)
        .groupBy("round")
        .agg(
            F.sum("reads").alias("n_reads"),
            F.count(F.lit(1)).alias("n_unique"),
            F.max("reads").alias("top_reads"),
            F.max(F.col("reads") * 1e6 / F.col("total")).alias("top_rpm"),
            F.max(share).alias("top1_share"),
            F.round(entropy(share), 9).alias("shannon_bits"),
            F.count_if(F.col("reads") == 1).alias("n_singletons"),
            F.avg((F.col("reads") == 1).cast("double")).alias("singleton_share"),
            F.count_if(F.col("reads") >= 10).alias("n_ge_10"),
            F.count_if(F.col("reads") >= 100).alias("n_ge_100"),
        )
    )


def shannon(counts: DataFrame) -> DataFrame:
    share = F.col("reads") / F.col("total")
    return with_totals(counts).groupBy("round").agg(F.round(entropy(share), 9).alias("shannon_bits"))


def top_coverage(counts: DataFrame, n: int) -> DataFrame:
    """Share of a round's reads in its n most frequent sequences; 0 for n <= 0, 1 if the round has no more."""
    total = round_totals(counts)
    if n <= 0:
        return total.select("round", F.lit(0.0).alias("coverage"))
    best = top(counts, n).groupBy("round").agg(F.sum("reads").alias("best"))
    return total.join(best, "round").select("round", (F.col("best") / F.col("total")).alias("coverage"))


def length_warning(counts: DataFrame, expected: int) -> DataFrame:
    """Whether unique lengths spread (sample deviation over 5) or miss the expected one (by over 8)."""
    n = F.length("seq")
    return counts.groupBy("round").agg((F.coalesce(F.stddev_samp(n) > 5, F.lit(False)) | (F.abs(F.avg(n) - expected) > 8)).alias("length_warning"))


def modal_length(counts: DataFrame) -> DataFrame:
    """The length with most reads in each round, the shorter on a tie."""
    by = counts.groupBy("round", F.length("seq").alias("len")).agg(F.sum("reads").alias("n"))
    return by.groupBy("round").agg(F.max_by("len", F.struct("n", -F.col("len"))).alias("modal_length"))


def length_distribution(counts: DataFrame, top_n: int = 5) -> DataFrame:
    """The commonest lengths of unique sequences in each round, with their share."""
    by = counts.groupBy("round", F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("round").agg(F.count(F.lit(1)).alias("all"))
    order = Window.partitionBy("round").orderBy(F.desc("n"), "len")
    placed = by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
    return placed.join(total, "round").select("round", "place", "len", "n", (F.col("n") / F.col("all")).alias("share"))


def expected_uniques(counts: DataFrame, depth: int) -> DataFrame:
    """Expected unique sequences of a draw of depth reads without replacement, in closed form; all of them from the total on.

    A sequence is drawn with chance 1 - C(total - reads, depth) / C(total, depth), which depends on its reads alone; so
    sequences are grouped by reads first, and a round becomes a short histogram.
    """
    if depth <= 0:
        raise ValueError("depth must be positive")
    histogram = with_totals(counts).groupBy("round", "total", "reads").agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(0).cast("long"), F.col("reads") - 1)
    # C(t - r, d) / C(t, d) = prod_{i<r} (t - d - i) / (t - i)
    missed = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), (F.col("total") - depth - i) / (F.col("total") - i)))
    chance = F.when(F.col("total") <= depth, 1.0).otherwise(1 - missed)
    return histogram.groupBy("round").agg(F.round(F.sum(F.col("n") * chance), 6).alias("expected_unique"))


def rarefied(counts: DataFrame, depth: int, seed: int = 42) -> DataFrame:
    """A draw of depth reads of each round without replacement: reads of each drawn sequence.

    Each read has a hash; the draw is the depth reads with the smallest. It is exact, repeats for a seed, and is spread over
    all tasks: a window keeps depth rows a round and task before the shuffle.
    """
    if depth <= 0:
        raise ValueError("depth must be positive")
    each = counts.select("round", "seq", F.explode(F.sequence(F.lit(1).cast("long"), "reads")).alias("i"))
    order = Window.partitionBy("round").orderBy(F.xxhash64("seq", "i", F.lit(seed)), "seq", "i")
    drawn = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)
    return drawn.groupBy("round", "seq").agg(F.count(F.lit(1)).alias("reads"))


def subsample(reads: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of each round, by the smallest hash of their record number."""
    order = Window.partitionBy("round").orderBy(F.xxhash64("rec", F.lit(seed)), "rec")
    return reads.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
