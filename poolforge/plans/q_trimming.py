"""Queries on trimming, orientation and demultiplexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import one_off_pattern
from ..operators import counts as C
from ..operators import trimming as T
from ..registry import query
from . import derived as D

_TAGS = {1: "ATTGT", 2: "CTGAG", 3: "AATTT", 4: "AACGG", 5: "CCGCC", 6: "ATGGA", 7: "GACAT"}
_FAR = [(t, r) for r, t in _TAGS.items() if r in (1, 2, 5, 7)]


def _cut(spark, sf):
    """Reads without their tag."""
    return D.reads(spark, sf).select("round", "rec", F.substring("seq", 5 + F.col("round") % 4, F.length("seq")).alias("seq"))


@query("t01_linked_trim", f"with {D.READS} select round, rec, substr(seq, length(seq) - 49, 30) as seq from reads")
def t01(spark, sf):
    return T.linked_trim(D.reads(spark, sf), D.FIVE, D.THREE).select("round", "rec", "seq")


@query("t02_five_prime_trim", f"with {D.READS} select round, rec, substr(seq, length(seq) - 49) as seq from reads")
def t02(spark, sf):
    return T.linked_trim(D.reads(spark, sf), five=D.FIVE).select("round", "rec", "seq")


@query("t03_three_prime_trim", f"with {D.READS} select round, rec, substr(seq, 1, length(seq) - 20) as seq from reads")
def t03(spark, sf):
    return T.linked_trim(D.reads(spark, sf), three=D.THREE).select("round", "rec", "seq")


@query("t05_strict_trim", f"with {D.READS} select round, rec, substr(seq, length(seq) - 49, 30) as seq from reads")
def t05(spark, sf):
    return T.strict_trim(_cut(spark, sf), D.FIVE, D.THREE).select("round", "rec", "seq")


@query("t16_trim_and_count", f"with {D.INSERTS} select round, seq, reads from icounts")
def t16(spark, sf):
    return C.unique_counts(T.strict_trim(_cut(spark, sf), D.FIVE, D.THREE))


@query("t10_reoriented", f"with {D.READS} select rec, reverse(translate(seq, 'ACGT', 'TGCA')) as seq, reverse(seq) as qual from reads")
def t10(spark, sf):
    return T.reoriented(D.reads(spark, sf).select("rec", "seq", F.col("seq").alias("qual")))


_CALL = "case " + " ".join(f"when regexp_matches(seq, '^(?:{one_off_pattern(b)})') then {r}" for b, r in _FAR) + " end"


@query("t11_demultiplexed", f"with {D.READS}, d as (select rec, seq, {_CALL} as call from reads) select rec, cast(call as integer) as round, case when call is null then seq else substr(seq, 6) end as seq from d")
def t11(spark, sf):
    return T.demultiplexed(D.reads(spark, sf).select("rec", "seq"), _FAR)


@query("t13_demux_report", f"with {D.READS}, d as (select cast({_CALL} as integer) as round from reads) select round, count(*) as n, count(*) / sum(count(*)) over () as share from d group by round")
def t13(spark, sf):
    return T.demux_report(T.demultiplexed(D.reads(spark, sf).select("rec", "seq"), _FAR))


@query("t09_override_lengths", f"with {D.INSERTS} select round, 30 as mode_length, 1.0::double as mode_share from icounts group by round")
def t09(spark, sf):
    from ..operators.signals import insert_lengths

    return insert_lengths(C.unique_counts(T.strict_trim(_cut(spark, sf), D.FIVE, D.THREE)), 0, 0)


@query("s08_head_sample", f"with {D.READS} select rec, seq from reads where rec < 5000")
def s08(spark, sf):
    from ..sources.fastq import first_records

    return first_records(D.reads(spark, sf), 5000).select("rec", "seq")


@query("s05_paired_scan", f"with {D.READS}, a as (select rec, seq from reads where round = 1), b as (select rec, reverse(seq) as mate_seq from reads where round = 1) select a.rec, seq, mate_seq from a join b on a.rec = b.rec")
def s05(spark, sf):
    from ..sources.fastq import paired

    a = D.reads(spark, sf).where("round = 1").select("rec", "seq")
    return paired(a, a.withColumn("seq", F.reverse("seq")))


@query("j01_round_map", f"with {D.READS} select rec, round from reads")
def j01(spark, sf):
    from ..sources.tables import with_rounds

    r = D.reads(spark, sf).select(F.concat(F.lit("round_"), F.col("round").cast("string")).alias("file"), "rec")
    rounds = spark.createDataFrame([(f"round_{i}", i) for i in range(1, 8)], "file string, round int")
    return with_rounds(r, rounds).select("rec", "round")


@query("a51_extraction_yield", f"with {D.READS} select round, count(*) as n_in, count(*) filter (seq like '%CCATGCATGCATGCATGCAT') as n_out, count(*) filter (seq like '%CCATGCATGCATGCATGCAT') / count(*) as share from reads group by round")
def a51(spark, sf):
    out = F.count_if(F.col("seq").endswith(D.THREE))
    return D.reads(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("n_in"), out.alias("n_out"), (out / F.count(F.lit(1))).alias("share"))


@query("b04_simulated_pool")
def b04(spark, sf):
    from ..operators.batch import simulated_pool

    return simulated_pool(spark, D.FIVE, D.THREE, 3, 500)
