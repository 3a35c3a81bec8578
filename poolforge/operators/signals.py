"""How well a pool's reads agree with called flanks: match rates, positions, variants, strands, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import at_offset, contains_one_off, near_prefix, rc
from .counts import counted


def _share(hit: Column) -> Column:
    """Share of reads, over rows of unique sequences."""
    return F.sum(F.when(hit, F.col("reads")).otherwise(0)) / F.sum("reads")


def match_rate(reads: DataFrame, primer: str) -> DataFrame:
    """Share of reads with a window within one substitution of primer; shorter reads are left out.

    reads: round and seq, or counts (with reads); equal reads are counted first and searched once.
    """
    return counted(reads).where(F.length("seq") >= len(primer)).groupBy("round").agg(_share(contains_one_off(F.col("seq"), primer)).alias("match_rate"))


def position_consistency(reads: DataFrame, primer: str, offset: int, slack: int = 3, from_end: bool = False) -> DataFrame:
    """Share of reads (or counts) with primer (one substitution allowed) near its offset."""
    return counted(reads).groupBy("round").agg(_share(at_offset(F.col("seq"), primer, offset, slack, from_end)).alias("consistency"))


def flank_variants(counts: DataFrame, length: int, offset: int = 0, from_end: bool = False, k: int = 3) -> DataFrame:
    """The k commonest words of this length at this offset in each round."""
    start = F.length("seq") - (offset + length) + 1 if from_end else F.lit(offset + 1)
    words = counts.where(F.length("seq") >= offset + length).select("round", F.substring("seq", start, F.lit(length)).alias("variant"), "reads")
    by = words.groupBy("round", "variant").agg(F.sum("reads").alias("n"))
    order = Window.partitionBy("round").orderBy(F.desc("n"), "variant")
    return by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def insert_lengths(counts: DataFrame, five: int, three: int) -> DataFrame:
    """Mode and mode share of max(0, length - five - three), the shorter on a tie."""
    by = counts.groupBy("round", F.greatest(F.length("seq") - (five + three), F.lit(0)).alias("len")).agg(F.sum("reads").alias("n"))
    return by.groupBy("round").agg(F.max_by("len", F.struct("n", -F.col("len"))).alias("mode_length"), (F.max("n") / F.sum("n")).alias("mode_share"))


def _strand(five: str, three: str) -> Column:
    seq = F.col("seq")
    return F.when(near_prefix(seq, five), "forward").when(near_prefix(seq, rc(three)), "reverse").otherwise("ambiguous")


def strands(reads: DataFrame, five: str, three: str) -> DataFrame:
    """Forward, reverse and ambiguous reads (or counts) of each round."""
    by = counted(reads).select("round", "reads", _strand(five, three).alias("strand")).groupBy("round")
    return by.agg(*[F.sum(F.when(F.col("strand") == s, F.col("reads")).otherwise(0)).alias(s) for s in ("forward", "reverse", "ambiguous")])


def orientation(strand_counts: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """FORWARD, REVERSE or MIXED by the share of reverse reads among those that match; FORWARD if none does."""
    share = F.try_divide(F.col("reverse"), F.col("forward") + F.col("reverse"))
    call = F.when(share.isNull() | (share < low), "FORWARD").when(share > high, "REVERSE").otherwise("MIXED")
    return strand_counts.select("round", call.alias("orientation"))


def persistence(rates: DataFrame, column: str) -> DataFrame:
    """1 - clip(deviation / mean) over rounds; null under two rounds or for a mean under 0.1."""
    x = rates.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    value = 1 - F.least(F.greatest(F.col("s") / F.col("m"), F.lit(0.0)), F.lit(1.0))
    return x.select(F.when((F.col("n") >= 2) & (F.col("m") >= 0.1), F.round(value, 9)).alias("persistence"))


def single_place(seq: Column, core: str, window: int) -> Column:
    """Array of the one place of core within the first ``window`` bases; null unless there is just one."""
    head = F.substring(seq, 1, window)
    first = F.instr(head, core) - 1
    again = F.instr(F.substring(head, first + 2, F.lit(window)), core)
    return F.when((first >= 0) & (again == 0), F.array(first))


def core_places(counts: DataFrame, core: str, window: int) -> DataFrame:
    """round, place and reads of sequences that hold core exactly once within the first ``window`` bases."""
    one = counts.select("round", "reads", F.element_at(single_place(F.col("seq"), core, window), 1).alias("place")).where("place is not null")
    return one.groupBy("round", "place").agg(F.sum("reads").alias("n"))


def agreed_place(places: DataFrame, agreement: float = 0.8) -> DataFrame:
    """The place that enough of a round's single-copy reads share."""
    best = places.groupBy("round").agg(F.max_by("place", F.struct("n", -F.col("place"))).alias("place"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where(F.col("n") / F.col("all") >= agreement).select("round", "place")
