"""Queries on positional profiles, composition and k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import profiles as P
from ..registry import query
from . import derived as D


def _counts(spark, sf):
    return C.unique_counts(D.reads(spark, sf))


def _inserts(spark, sf):
    return C.unique_counts(D.inserts(spark, sf))


_HEAD = ", prof as (select round, cast(i as integer) as pos, substr(seq, cast(i + 1 as integer), 1) as base, cast(sum(reads) as bigint) as n from {t}, unnest(range(0, {k})) as u(i) where i < length(seq) group by all)"
_TAIL = ", prof as (select round, cast(i as integer) as pos, substr(seq, cast(length(seq) - i as integer), 1) as base, cast(sum(reads) as bigint) as n from {t}, unnest(range(0, {k})) as u(i) where i < length(seq) group by all)"
_CONS = ", cons as (select round, pos, arg_max(base, n * 256 - ascii(base)) as base, max(n) / sum(n) as support, cast(sum(n) as bigint) as covered from prof group by round, pos having sum(n) >= 500)"
_KMERS = f"with {D.INSERTS}, k as (select round, substr(seq, cast(i as integer), 6) as kmer, cast(sum(reads) as bigint) as weight from icounts, unnest(range(1, 26)) as u(i) group by all)"


@query("a10_consensus_5p", f"with {D.COUNTS}{_HEAD.format(t='counts', k=60)}{_CONS} select * from cons")
def a10(spark, sf):
    return P.consensus(P.base_counts(_counts(spark, sf), 60))


@query("a10_consensus_3p", f"with {D.COUNTS}{_TAIL.format(t='counts', k=60)}{_CONS} select * from cons")
def a10t(spark, sf):
    return P.consensus(P.base_counts(_counts(spark, sf), 60, from_end=True))


@query(
    "a11_base_fractions",
    f"""with {D.COUNTS}{_HEAD.format(t='counts', k=30)}, f as (select round, pos, {', '.join(f"coalesce(sum(n) filter (base = '{b}'), 0) / sum(n) as f_{b.lower()}" for b in 'ACGTN')} from prof group by round, pos)
    select *, greatest(f_a, f_c, f_g, f_t, f_n) as top, greatest(f_a, f_c, f_g, f_t, f_n) > 0.4 as constant_suspect from f""",
)
def a11(spark, sf):
    return P.base_fractions(P.base_counts(_counts(spark, sf), 30))


@query("a12_raw_audit", f"with {D.READS}, x as (select *, row_number() over (partition by round order by rec) as k from reads) select round, count(*) as n, avg(length(seq)) as mean_length, cast(min(length(seq)) as integer) as shortest, cast(max(length(seq)) as integer) as longest from x where k <= 2000 group by round")
def a12(spark, sf):
    return P.read_audit(D.reads(spark, sf))


@query("a13_trimmed_audit", f"with {D.INSERTS}, l as (select round, cast(length(seq) as integer) as len, cast(sum(reads) as bigint) as n from icounts group by all) select i.round, count(*) as n_unique, cast(sum(reads) as bigint) as n_reads, max(m.mode_length) as mode_length, cast(coalesce(sum(reads) filter (seq like '%AGATCGGAAGAGC%'), 0) as bigint) as truseq_reads from icounts i join (select round, arg_max(len, n) as mode_length from l group by round) m on i.round = m.round group by i.round")
def a13(spark, sf):
    counts = _inserts(spark, sf)
    hit = F.contains("seq", F.lit("AGATCGGAAGAGC"))
    base = counts.groupBy("round").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("reads").alias("n_reads"), F.sum(F.when(hit, F.col("reads")).otherwise(0)).alias("truseq_reads"))
    return base.join(C.modal_length(counts).withColumnRenamed("modal_length", "mode_length"), "round")


@query("a17_gc", f"with {D.INSERTS}, g as (select round, (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) as gc from icounts) select round, round(avg(gc), 9) as gc_mean, round(stddev_pop(gc), 9) as gc_sd from g group by round")
def a17(spark, sf):
    return P.gc_stats(_inserts(spark, sf))


@query("a18_positional_entropy", f"with {D.INSERTS}{_HEAD.format(t='icounts', k=10)}, s as (select *, n / sum(n) over (partition by round, pos) as share from prof) select round, pos, max(share) as top, round(-sum(share * log2(share)), 9) as bits from s group by round, pos")
def a18(spark, sf):
    return P.positional_entropy(P.base_counts(_inserts(spark, sf), 10))


@query("a18_positional_entropy_tail", f"with {D.INSERTS}{_TAIL.format(t='icounts', k=10)}, s as (select *, n / sum(n) over (partition by round, pos) as share from prof) select round, pos, max(share) as top, round(-sum(share * log2(share)), 9) as bits from s group by round, pos")
def a18t(spark, sf):
    return P.positional_entropy(P.base_counts(_inserts(spark, sf), 10, from_end=True))


@query("a19_top_kmers", _KMERS + ", r as (select *, cast(row_number() over (partition by round order by weight desc, kmer) as integer) as place, weight / sum(weight) over (partition by round) as share from k) select round, place, kmer, weight, share from r where place <= 10")
def a19(spark, sf):
    return P.top_kmers(_inserts(spark, sf), 6, 10)


@query("a21_contamination", f"with {D.INSERTS} select round, avg(case when seq like '%AGATC%' then 1.0::double else 0 end) as unique_share, coalesce(sum(reads) filter (seq like '%AGATC%'), 0) / sum(reads) as read_share, cast(coalesce(sum(reads) filter (seq like '%AGATC%'), 0) as bigint) as hit_reads from icounts group by round")
def a21(spark, sf):
    hit = F.contains("seq", F.lit("AGATC"))  # a short probe, so that derived pools hold it
    reads = F.sum(F.when(hit, F.col("reads")).otherwise(0))
    return _inserts(spark, sf).groupBy("round").agg(F.avg(hit.cast("double")).alias("unique_share"), (reads / F.sum("reads")).alias("read_share"), reads.alias("hit_reads"))


@query(
    "a22_adapter_hits",
    f"""with {D.READS}, p as (select * from (values ('NEXTERA', 'CTGTCTCTTATAC', 'AGATGTGTATAAG'), ('TRUSEQ_R1', 'AGATCGGAAGAGC', 'GCTCTTCCGATCT')) t(adapter, f, r))
    select round, adapter, count(*) filter (contains(seq, f) or contains(seq, r)) as hits from reads, p group by round, adapter""",
)
def a22(spark, sf):
    return P.adapter_hits(D.reads(spark, sf))


@query("a52_read_level_consensus", f"with {D.COUNTS}{_HEAD.format(t='counts', k=45)}{_CONS} select round, pos, base, support from cons")
def a52(spark, sf):
    return P.consensus(P.base_counts(_counts(spark, sf), 45)).select("round", "pos", "base", "support")


@query(
    "a53_read_state",
    f"""with {D.READS} select cast(round as integer) as round, count(*) as n, cast(min(length(seq)) as integer) as shortest, cast(max(length(seq)) as integer) as longest, count(*) filter (contains(seq, '{D.FIVE}')) as with_5p, count(*) filter (contains(seq, '{D.THREE}')) as with_3p from reads group by grouping sets ((round), ())""",
)
def a53(spark, sf):
    s = F.col("seq")
    return D.reads(spark, sf).rollup("round").agg(F.count(F.lit(1)).alias("n"), F.min(F.length(s)).alias("shortest"), F.max(F.length(s)).alias("longest"), F.count_if(F.contains(s, F.lit(D.FIVE))).alias("with_5p"), F.count_if(F.contains(s, F.lit(D.THREE))).alias("with_3p"))


@query("a54_donor_check", f"with {D.INSERTS} select round, count(*) / sum(reads) as distinct_share, max(reads) / sum(reads) as top_share, sum(reads) filter (length(seq) between 28 and 32) / sum(reads) as near_n from icounts group by round")
def a54(spark, sf):
    near = F.sum(F.when(F.length("seq").between(28, 32), F.col("reads")))
    return _inserts(spark, sf).groupBy("round").agg((F.count(F.lit(1)) / F.sum("reads")).alias("distinct_share"), (F.max("reads") / F.sum("reads")).alias("top_share"), (near / F.sum("reads")).alias("near_n"))


@query("w12_weighted_median_length", f"with {D.COUNTS}, l as (select round, cast(length(seq) as integer) as len, sum(reads) as n from counts group by all), c as (select *, sum(n) over (partition by round order by len) as cum, sum(n) over (partition by round) as total from l) select round, min(len) as median_length from c where cum >= (total + 1) / 2 group by round")
def w12(spark, sf):
    return P.weighted_median_length(_counts(spark, sf))
