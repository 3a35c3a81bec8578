"""Queries on flags, consistency and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import profiles as P
from ..operators import qc as Q
from ..operators import signals as G
from ..registry import query
from . import derived as D
from .q_functions import _RC
from .q_inference import _MIXED, _STRANDS, _mixed


def _counts(spark, sf):
    return C.unique_counts(D.reads(spark, sf))


def _inserts(spark, sf):
    return C.unique_counts(D.inserts(spark, sf))


@query("q01_diversity_rises")
def q01(spark, sf):
    return Q.diversity_rises(_inserts(spark, sf))


@query("q02_low_match", "select l_orderkey, l_linenumber, (l_partkey % 101) / 100.0::double < 0.4 or (l_suppkey % 101) / 100.0::double < 0.4 as low from lineitem")
def q02(spark, sf):
    rate = lambda c: (F.col(c) % 101) / 100.0
    x = D.table(spark, sf, "lineitem").withColumn("match_rate_5p", rate("l_partkey")).withColumn("match_rate_3p", rate("l_suppkey"))
    return x.select("l_orderkey", "l_linenumber", Q.low_match(x).alias("low"))


@query("q03_length_variation", f"with {D.COUNTS}, l as (select round, length(seq) as len, sum(reads) as n from counts group by all), m as (select round, arg_max(len, n * 1000 - len) as m from l group by round) select count(distinct m) as n_modes, count(distinct m) > 2 as flag from m")
def q03(spark, sf):
    return Q.length_variation(_counts(spark, sf))


@query("q04_strand_mix", f"with {_MIXED}{_STRANDS} select round, reverse / (forward + reverse + ambiguous) as reverse_share, reverse / (forward + reverse + ambiguous) > 0.2 as flag from strands")
def q04(spark, sf):
    return Q.strand_mix(G.strands(_mixed(spark, sf), D.FIVE, D.THREE))


@query("q05_low_reads", f"with {D.READS} select round, count(*) as total, count(*) < 8585 as flag from reads group by round")
def q05(spark, sf):
    return Q.low_reads(_counts(spark, sf), 8585)


@query("q06_adapter_contamination", f"with {D.READS}, h as (select count(*) as n_in from reads where round = 1), p as (select unnest(['NEXTERA', 'TRUSEQ_R1']) as adapter) select 1 as round, adapter, 0 / n_in::double as share, 'none' as severity from p, h")
def q06(spark, sf):
    reads = D.reads(spark, sf)
    return Q.adapter_contamination(P.adapter_hits(reads), reads.groupBy("round").agg(F.count(F.lit(1)).alias("n_in")))


@query("q07_mode_changed", f"with {D.RUNS} select bioproject_id as dataset, count(*) as n, count(distinct library_strategy) as n_modes, count(*) >= 2 and count(distinct library_strategy) > 1 as flag from runs group by bioproject_id")
def q07(spark, sf):
    r = D.runs(spark, sf).select(F.col("bioproject_id").alias("dataset"), F.col("library_strategy").alias("extraction_mode"))
    return Q.mode_changed(r)


@query("q09_flags")
def q09(spark, sf):
    reads = D.reads(spark, sf)
    report = spark.createDataFrame([(1.0, 0.3, "READ_MERGING_RECOMMENDED")], "match_rate_5p double, match_rate_3p double, required_action string")
    n_in = reads.groupBy("round").agg(F.count(F.lit(1)).alias("n_in"))
    return Q.flags(_inserts(spark, sf), report, G.strands(_mixed(spark, sf), D.FIVE, D.THREE), P.adapter_hits(reads), n_in)


_TOPK = f"""with {D.INSERTS}, t as (select round, seq from (select *, row_number() over (partition by round order by reads desc, seq) as k from icounts) where k <= 10000),
raw as (select round, substr(seq, cast(i as integer), 6) as k from t, unnest(range(1, 26)) as u(i)), sets as (select distinct round, least(k, {_RC.format('k')}) as kmer from raw)"""
_JACC = """, sz as (select round, count(*) as n from sets group by round), b as (select x.round as a, y.round as b, count(*) as common from sets x join sets y on x.kmer = y.kmer and x.round < y.round group by all),
d as (select x.round as a, y.round as b, case when x.n + y.n - coalesce(common, 0) = 0 then 0 else 1 - coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)) end as distance from sz x join sz y on x.round < y.round left join b on b.a = x.round and b.b = y.round)"""


@query("e01_kmer_sets", _TOPK + " select round, kmer from sets")
def e01(spark, sf):
    return Q.kmer_sets(_inserts(spark, sf), 6)


@query("e02_jaccard_distance", _TOPK + _JACC + " select a, b, distance from d")
def e02(spark, sf):
    return Q.jaccard_distances(Q.kmer_sets(_inserts(spark, sf), 6))


@query("q10_kmer_consistency", _TOPK + _JACC + ", tr as (select f.distance as far, n.distance as near from d f join d n on f.a = n.a and n.b = n.a + 1 and f.b >= f.a + 2) select count(*) as n_triples, count(*) filter (far < near * (1 - 0.1::double)) as n_broken, count(*) filter (far < near * (1 - 0.1::double)) = 0 as monotone from tr")
def q10(spark, sf):
    return Q.monotone(Q.jaccard_distances(Q.kmer_sets(_inserts(spark, sf), 6)))


@query("j18_round_pairs", f"with {D.READS}, r as (select distinct round from reads) select a.round as a, b.round as b from r a join r b on a.round < b.round")
def j18(spark, sf):
    r = D.reads(spark, sf).select("round").distinct()
    return r.select(F.col("round").alias("a")).join(F.broadcast(r.select(F.col("round").alias("b"))), F.col("a") < F.col("b"))


@query("q12_pre", "select 'pre' as section, 'PASS' as status")
def q12(spark, sf):
    return Q.pre_check(_inserts(spark, sf))


@query("q13_alphabet", f"with {D.INSERTS}, x as (select count(*) as n, count(*) filter (regexp_matches(seq, '[^ACGT]')) as bad from icounts) select 'alphabet' as section, case when n = 0 or bad / n > 0.005 then 'FAIL' when bad / n > 0.001 then 'WARN' when bad > 0 then 'INFO' else 'PASS' end as status from x")
def q13(spark, sf):
    return Q.alphabet_check(_inserts(spark, sf))


@query("q14_lengths", "select 'lengths' as section, 'PASS' as status")
def q14(spark, sf):
    return Q.lengths_check(_inserts(spark, sf), 30)


@query("q15_trim_residue", f"with {D.COUNTS} select round, avg(case when starts_with(seq, 'ATTGTGGTAATACGA') then 1.0::double else 0 end) as starts_5p, avg(case when ends_with(seq, 'CCATGCATGCATGCA') then 1.0::double else 0 end) as ends_3p from counts group by round")
def q15r(spark, sf):
    return Q.residue_shares(_counts(spark, sf), "ATTGT" + D.FIVE, D.THREE)


@query("q15_trim_seq", "select 'trim_seq' as section, 'PASS' as status")
def q15(spark, sf):
    return Q.trim_check(_inserts(spark, sf), D.FIVE, D.THREE)


@query("q16_composition")
def q16(spark, sf):
    return Q.composition_check(_inserts(spark, sf))


@query("q17_diversity")
def q17(spark, sf):
    return Q.diversity_check(_inserts(spark, sf))


_CHANGE = f"""with {D.INSERTS}, t as (select sum(reads) filter (round = 1) as t0, sum(reads) filter (round = 7) as t1 from icounts), x as (select seq, max(reads) filter (round = 1) as n0, max(reads) filter (round = 7) as n1 from icounts where round in (1, 7) group by seq),
c as (select seq, round(log2((coalesce(n1, 0.5) / t1) / (coalesce(n0, 0.5) / t0)), 9) as log2fc from x, t)"""


@query("q18_enrichment", _CHANGE + " select seq, log2fc from c")
def q18e(spark, sf):
    return Q.enrichment(_inserts(spark, sf), 1, 7)


@query("q18_selection", _CHANGE + " select 'selection' as section, case when count(*) = 0 then 'FAIL' when max(log2fc) < 2 or count(*) < 100 then 'WARN' else 'PASS' end as status from c")
def q18(spark, sf):
    return Q.selection_check(Q.enrichment(_inserts(spark, sf), 1, 7))


@query("j14_top_traced", f"with {D.INSERTS}, b as (select seq from icounts where round = 7 order by reads desc, seq desc limit 5) select count(*) as n_traced from b where seq in (select seq from icounts where round = 1)")
def j14(spark, sf):
    return Q.top_traced(_inserts(spark, sf))


@query("q19_unique_ratio", f"with {D.INSERTS}, u as (select round, count(*) / sum(reads) as ratio from icounts group by round) select 'consistency' as section, case when count(*) >= 3 and arg_max(ratio, round) > arg_min(ratio, round) * 1.1::double then 'WARN' else 'PASS' end as status from u")
def q19(spark, sf):
    return Q.unique_ratio_check(_inserts(spark, sf))


@query("q19_primer_drift", "with x as (select o_orderkey as id, 'ACGT' as s5, 'TTTT' as s3, case o_orderkey % 3 when 0 then null when 1 then 'ACGT' else 'AC' end as f5, case when o_orderkey % 2 = 0 then null else 'TTTT' end as f3 from orders) select id, case when f5 is null and f3 is null then 'INFO' when (f5 <> '' and f5 <> s5) or (f3 <> '' and f3 <> s3) then 'WARN' else 'PASS' end as status from x")
def q19d(spark, sf):
    k = F.col("o_orderkey")
    five = F.when(k % 3 == 1, "ACGT").when(k % 3 == 2, "AC")
    return D.table(spark, sf, "orders").select(k.alias("id"), Q.primer_drift(F.lit("ACGT"), F.lit("TTTT"), five, F.when(k % 2 != 0, "TTTT")).alias("status"))


@query("q20_readiness")
def q20(spark, sf):
    return Q.readiness(_inserts(spark, sf), 30, D.FIVE, D.THREE)


@query("q20_worst", "select case when bool_or(l_returnflag = 'R') then 'FAIL' else 'PASS' end as worst from lineitem")
def q20w(spark, sf):
    return Q.worst(D.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("INFO").alias("status")))
