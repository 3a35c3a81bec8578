"""Queries on counts, ranks and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..registry import query
from . import derived as D


def _counts(spark, sf):
    return C.unique_counts(D.reads(spark, sf))


def _inserts(spark, sf):
    return C.unique_counts(D.inserts(spark, sf))


_TOTAL = ", totals as (select round, cast(sum(reads) as bigint) as total from counts group by round)"
_RANKED = ", ranked as (select *, row_number() over (partition by round order by reads desc, seq) as rank from counts)"


@query("a01_unique_counts", f"with {D.COUNTS} select round, seq, reads from counts")
def a01(spark, sf):
    return _counts(spark, sf)


@query("a02_reads_per_million", f"with {D.COUNTS}{_TOTAL} select c.round, seq, reads, reads * 1e6::double / total as rpm from counts c join totals t on c.round = t.round")
def a02(spark, sf):
    return C.with_rpm(_counts(spark, sf))


@query(
    "a03_count_stats",
    f"""with {D.COUNTS}{_TOTAL} select c.round, cast(sum(reads) as bigint) as n_reads, count(*) as n_unique, max(reads) as top_reads, max(reads * 1e6::double / total) as top_rpm,
    max(reads / total) as top1_share, round(-sum(reads / total * log2(reads / total)), 9) as shannon_bits, cast(count(*) filter (reads = 1) as bigint) as n_singletons,
    avg(case when reads = 1 then 1.0::double else 0 end) as singleton_share, count(*) filter (reads >= 10) as n_ge_10, count(*) filter (reads >= 100) as n_ge_100
    from counts c join totals t on c.round = t.round group by c.round""",
)
def a03(spark, sf):
    return C.round_stats(_counts(spark, sf))


@query("a05_shannon_entropy", f"with {D.COUNTS}{_TOTAL} select c.round, round(-sum(reads / total * log2(reads / total)), 9) as shannon_bits from counts c join totals t on c.round = t.round group by c.round")
def a05(spark, sf):
    return C.shannon(_counts(spark, sf))


@query("a06_top1_share", f"with {D.COUNTS} select round, max(reads) / sum(reads) as top1_share from counts group by round")
def a06(spark, sf):
    return _counts(spark, sf).groupBy("round").agg((F.max("reads") / F.sum("reads")).alias("top1_share"))


@query("a07_unique_count", f"with {D.COUNTS} select round, count(*) filter (reads > 0) as n_unique from counts group by round")
def a07(spark, sf):
    return _counts(spark, sf).groupBy("round").agg(F.count_if(F.col("reads") > 0).alias("n_unique"))


@query("a08_top_coverage", f"with {D.COUNTS}{_RANKED}, t as (select round, sum(reads) as total from counts group by round) select r.round, sum(reads) / max(total) as coverage from ranked r join t on r.round = t.round where rank <= 100 group by r.round")
def a08(spark, sf):
    return C.top_coverage(_counts(spark, sf), 100)


@query("a09_rarefied_sample")
def a09(spark, sf):
    return C.rarefied(_inserts(spark, sf), 500)


@query(
    "a09_expected_uniques",
    f"""with {D.INSERTS}, t as (select round, sum(reads) as total from icounts group by round),
    x as (select i.round, reads, total, list_reduce(list_prepend(1.0::double, list_transform(range(0, reads), lambda k: greatest(0.0::double, (total - 500 - k) / (total - k)))), lambda a, b: a * b) as missed from icounts i join t on i.round = t.round)
    select round, round(sum(case when total <= 500 then 1 else 1 - missed end), 6) as expected_unique from x group by round""",
)
def a09e(spark, sf):
    return C.expected_uniques(_inserts(spark, sf), 500)


@query("a14_length_distribution", f"with {D.COUNTS}, l as (select round, cast(length(seq) as integer) as len, count(*) as n from counts group by all), x as (select *, cast(row_number() over (partition by round order by n desc, len) as integer) as place, n / sum(n) over (partition by round) as share from l) select round, place, len, n, share from x where place <= 5")
def a14(spark, sf):
    return C.length_distribution(_counts(spark, sf))


@query("a15_modal_length", f"with {D.COUNTS}, l as (select round, cast(length(seq) as integer) as len, sum(reads) as n from counts group by all) select round, arg_max(len, n * 1000 - len) as modal_length from l group by round")
def a15(spark, sf):
    return C.modal_length(_counts(spark, sf))


@query("a20_singleton_fraction", f"with {D.COUNTS} select round, avg(case when reads = 1 then 1.0::double else 0 end) as singletons from counts group by round")
def a20(spark, sf):
    return _counts(spark, sf).groupBy("round").agg(F.avg((F.col("reads") == 1).cast("double")).alias("singletons"))


@query("a60_round_trajectory", f"with {D.COUNTS} select round, cast(sum(reads) as bigint) as n_reads, count(*) as n_unique, avg(case when reads = 1 then 1.0::double else 0 end) as singleton_share from counts group by round")
def a60(spark, sf):
    return C.round_stats(_counts(spark, sf)).select("round", "n_reads", "n_unique", "singleton_share")


@query("a65_length_warning", f"with {D.COUNTS} select round, coalesce(stddev_samp(length(seq)) > 5, false) or abs(avg(length(seq)) - 30) > 8 as length_warning from counts group by round")
def a65(spark, sf):
    return C.length_warning(_counts(spark, sf), 30)


@query("w01_rank", f"with {D.INSERTS} select round, seq, reads, cast(row_number() over (partition by round order by reads desc, seq) as integer) as rank from icounts")
def w01(spark, sf):
    return C.ranked(_inserts(spark, sf))


@query(
    "w02_top_sequences",
    f"""with {D.COUNTS}{_TOTAL}{_RANKED}, e as (select c.round, round(-sum(reads / total * log2(reads / total)), 9) as shannon_bits from counts c join totals t on c.round = t.round group by c.round)
    select r.round, seq, reads, cast(rank as integer) as rank, reads * 1e6::double / total as rpm, shannon_bits from ranked r join totals t on r.round = t.round join e on r.round = e.round where rank <= 10""",
)
def w02(spark, sf):
    counts = _counts(spark, sf)
    best = C.top(counts, 10).join(F.broadcast(C.round_totals(counts)), "round").withColumn("rpm", F.col("reads") * 1e6 / F.col("total")).drop("total")
    return best.join(F.broadcast(C.shannon(counts)), "round")


@query("w03_top5_by_reads_then_sequence", f"with {D.INSERTS} select round, seq, reads from icounts where round = 7 order by reads desc, seq desc limit 5")
def w03(spark, sf):
    return _inserts(spark, sf).where("round = 7").orderBy(F.desc("reads"), F.desc("seq")).limit(5)


@query("w04_consecutive_rounds", f"with {D.INSERTS}, u as (select round, count(*) as uniques from icounts group by round) select round, uniques, lag(uniques) over (order by round) as before from u")
def w04(spark, sf):
    from pyspark.sql import Window

    u = _inserts(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("uniques"))
    return u.withColumn("before", F.lag("uniques").over(Window.orderBy("round")))


@query("w10_unique_ratio", f"with {D.INSERTS}, u as (select round, count(*) / sum(reads) as ratio from icounts group by round) select arg_min(ratio, round) as first, arg_max(ratio, round) as last from u")
def w10(spark, sf):
    by = _inserts(spark, sf).groupBy("round").agg((F.count(F.lit(1)) / F.sum("reads")).alias("ratio"))
    return by.agg(F.min_by("ratio", "round").alias("first"), F.max_by("ratio", "round").alias("last"))


@query("x14_subsample")
def x14(spark, sf):
    return C.subsample(D.reads(spark, sf), 1000)


@query("s30_yield_difference", f"with {D.READS}, a as (select round, count(*) as n from reads where round <= 5 group by round), b as (select round, count(*) as n from reads where round >= 3 and rec % 3 <> 0 group by round) select coalesce(a.round, b.round) as round, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.round = b.round")
def s30(spark, sf):
    from ..operators.scoring import yields

    n = F.count(F.lit(1)).alias("n_out")
    r = D.reads(spark, sf)
    return yields(r.where("round <= 5").groupBy("round").agg(n), r.where("round >= 3 and rec % 3 <> 0").groupBy("round").agg(n))


@query("a29_trim_yield", f"with {D.READS} select round, count(*) as n_in, count(*) filter (seq like '%CCATGCATGCATGCATGCAT') as n_out from reads group by round")
def a29(spark, sf):
    return D.reads(spark, sf).groupBy("round").agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("seq").endswith(D.THREE)).alias("n_out"))


@query("a30_low_yield_inputs", f"with {D.READS}, x as (select concat('round_', cast(round as varchar)) as input, count(*) filter (length(seq) = 77) / count(*) as kept from reads group by round), b as (select max(kept) as best from x) select input, kept from x, b where kept < 0.5 or kept < 0.5 * best")
def a30(spark, sf):
    from ..operators.scoring import low_yields

    trims = D.reads(spark, sf).groupBy(F.concat(F.lit("round_"), F.col("round").cast("string")).alias("input")).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.length("seq") == 77).alias("n_out"))
    return low_yields(trims)
