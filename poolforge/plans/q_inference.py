"""Queries on match signals, flank inference and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import one_off_pattern, rc
from ..operators import counts as C
from ..operators import inference as I
from ..operators import profiles as P
from ..operators import signals as G
from ..registry import query
from . import derived as D
from .q_profiles import _CONS, _HEAD, _TAIL

_NEAR5, _NEAR3 = one_off_pattern(D.FIVE), one_off_pattern(D.THREE)


@query("a23_match_rate", f"with {D.READS} select round, avg(case when regexp_matches(seq, '{_NEAR3}') then 1.0::double else 0 end) as match_rate from reads where length(seq) >= 20 group by round")
def a23(spark, sf):
    return G.match_rate(D.reads(spark, sf), D.THREE)


@query("a24_position_consistency", f"with {D.READS} select round, avg(case when regexp_matches(seq, '^.{{2,8}}(?:{_NEAR5})') then 1.0::double else 0 end) as consistency from reads group by round")
def a24(spark, sf):
    return G.position_consistency(D.reads(spark, sf), D.FIVE, 5)


@query("a25_flank_variants", f"with {D.COUNTS}, v as (select round, substr(seq, length(seq) - 19, 20) as variant, cast(sum(reads) as bigint) as n from counts group by all), r as (select *, cast(row_number() over (partition by round order by n desc, variant) as integer) as place from v) select round, variant, n, place from r where place <= 3")
def a25(spark, sf):
    return G.flank_variants(C.unique_counts(D.reads(spark, sf)), 20, from_end=True)


@query("a16_insert_lengths", f"with {D.COUNTS}, l as (select round, cast(greatest(length(seq) - 47, 0) as integer) as len, sum(reads) as n from counts group by all) select round, arg_max(len, n * 1000 - len) as mode_length, max(n) / sum(n) as mode_share from l group by round")
def a16(spark, sf):
    return G.insert_lengths(C.unique_counts(D.reads(spark, sf)), 27, 20)


_MIXED = f"""{D.READS}, mixed as (select round, case when rec % 3 = 0 then reverse(translate(substr(seq, 5 + round % 4), 'ACGT', 'TGCA')) else substr(seq, 5 + round % 4) end as seq from reads)"""
_STRANDS = f""", strands as (select round, count(*) filter (s = 'f') as forward, count(*) filter (s = 'r') as reverse, count(*) filter (s = 'a') as ambiguous from (select round, case when regexp_matches(seq, '^(?:{_NEAR5})') then 'f' when regexp_matches(seq, '^(?:{one_off_pattern(rc(D.THREE))})') then 'r' else 'a' end as s from mixed) group by round)"""


def _mixed(spark, sf):
    from ..functions.sequences import reverse_complement

    cut = F.substring("seq", 5 + F.col("round") % 4, F.length("seq"))
    return D.reads(spark, sf).select("round", F.when(F.col("rec") % 3 == 0, reverse_complement(cut)).otherwise(cut).alias("seq"))


@query("a27_strands", f"with {_MIXED}{_STRANDS} select * from strands")
def a27(spark, sf):
    return G.strands(_mixed(spark, sf), D.FIVE, D.THREE)


@query("a26_orientation", f"with {_MIXED}{_STRANDS} select round, case when forward + reverse = 0 or reverse / (forward + reverse) < 0.05 then 'FORWARD' when reverse / (forward + reverse) > 0.95 then 'REVERSE' else 'MIXED' end as orientation from strands")
def a26(spark, sf):
    return G.orientation(G.strands(_mixed(spark, sf), D.FIVE, D.THREE))


@query("a28_persistence", f"with {D.COUNTS}, s as (select round, max(reads) / sum(reads) as rate from counts group by round) select case when count(*) >= 2 and avg(rate) >= 0.001 then round(1 - least(greatest(stddev_samp(rate) / avg(rate), 0), 1), 9) end as persistence from s where rate * 100 >= 0.1")
def a28(spark, sf):
    rates = C.round_stats(C.unique_counts(D.reads(spark, sf))).select((F.col("top1_share") * 100).alias("rate")).where("rate >= 0.1")
    # Shares are scaled to percent to lie above the rule's least mean.
    return G.persistence(rates, "rate")


_BOUNDARY = """, s as (select *, lead(support) over (partition by round order by pos) as nxt, quantile_cont(support, 0.5) over (partition by round order by pos rows between 14 preceding and 1 preceding) as med, count(*) over (partition by round) as n from cons),
e as (select round, max(n) as n, coalesce(min(pos) filter (nxt is not null and ((pos >= 14 and med >= 0.90 and support <= med - 0.12::double and greatest(support, nxt) < 0.85) or greatest(support, nxt) < 0.55)), max(n)) as fin from s group by round),
g as (select s.round, avg(case when support >= 0.75 then 1.0::double else 0 end) as strong from s join e on s.round = e.round where pos < fin group by s.round)
select e.round, cast(case when n >= 14 and fin >= 14 and strong >= 0.8 then fin else 0 end as bigint) as boundary from e left join g on e.round = g.round"""


@query("x01_boundary_5p", f"with {D.COUNTS}{_HEAD.format(t='counts', k=60)}{_CONS}{_BOUNDARY}")
def x01(spark, sf):
    return I.flank_boundaries(P.consensus(P.base_counts(C.unique_counts(D.reads(spark, sf)), I.MAX_LEN)))


@query("x01_boundary_3p", f"with {D.COUNTS}{_TAIL.format(t='counts', k=60)}{_CONS}{_BOUNDARY}")
def x01t(spark, sf):
    return I.flank_boundaries(P.consensus(P.base_counts(C.unique_counts(D.reads(spark, sf)), I.MAX_LEN, from_end=True)))


@query(
    "w05_support_cliff",
    f"with {D.COUNTS}{_HEAD.format(t='counts', k=60)}{_CONS}, s as (select round, pos, support, quantile_cont(support, 0.5) over (partition by round order by pos rows between 14 preceding and 1 preceding) as base from cons) select round, min(pos) as cliff from s where pos >= 14 and base >= 0.90 and support <= base - 0.12::double group by round",
)
def w05(spark, sf):
    return I.support_cliffs(P.consensus(P.base_counts(C.unique_counts(D.reads(spark, sf)), 60)))


@query("w06_floor_run", f"with {D.COUNTS}{_HEAD.format(t='counts', k=60)}{_CONS}, s as (select round, pos, support, lead(support) over (partition by round order by pos) as nxt from cons) select round, min(pos) as floor_at from s where support < 0.55 and nxt < 0.55 group by round")
def w06(spark, sf):
    return I.floor_runs(P.consensus(P.base_counts(C.unique_counts(D.reads(spark, sf)), 60)))


@query("w07_strong_share", f"with {D.COUNTS}{_HEAD.format(t='counts', k=60)}{_CONS} select round, avg(case when support >= 0.75 then 1.0::double else 0 end) as strong from cons where pos < 26 group by round")
def w07(spark, sf):
    return I.strong_shares(P.consensus(P.base_counts(C.unique_counts(D.reads(spark, sf)), 60)), 26)


@query("x02_flanks")
def x02(spark, sf):
    found = I.detect_flanks(D.reads(spark, sf))
    rows = [(k, v["five"].sequence, v["three"].sequence, float(v["five"].confidence), float(v["three"].confidence), v["random_length"]) for k, v in sorted(found.items())]
    return spark.createDataFrame(rows, "round int, five string, three string, confidence_5p double, confidence_3p double, random_length int")


@query("x05_core_places", f"with {D.READS}, m as (select round, list_filter(range(0, 31), lambda i: substr(seq, i + 1, 10) = 'CACTATAGGG') as spots from reads) select round, cast(spots[1] as integer) as place, count(*) as n from m where len(spots) = 1 group by all")
def x05p(spark, sf):
    return G.core_places(C.unique_counts(D.reads(spark, sf)), "CACTATAGGG", 40)


@query("x05_shared_constant", f"select * from (values (1, '{D.FIVE}', 5), (2, '{D.FIVE}', 6), (3, '{D.FIVE}', 7), (4, '{D.FIVE}', 4), (5, '{D.FIVE}', 5), (6, '{D.FIVE}', 6), (7, '{D.FIVE}', 7)) t(round, constant, place)")
def x05(spark, sf):
    reads = D.reads(spark, sf)
    called = I.detect_flanks(reads.where("round = 1"))[1]["five"].sequence
    constant, offsets = I.shared_constant(reads, called)
    return spark.createDataFrame([(k, constant, v) for k, v in sorted(offsets.items())], "round int, constant string, place int")


_SIGNALS = """with x as (select l_orderkey as id, l_linenumber as line, (l_partkey % 101) / 100.0::double as m5, (l_suppkey % 101) / 100.0::double as m3, (l_orderkey % 101) / 100.0::double as sharp, l_linenumber % 5 = 0 as split, (l_quantity % 51) / 50.0::double as conf from lineitem)"""


def _signals(spark, sf):
    hundredth = lambda c: (F.col(c) % 101) / 100.0
    return D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), hundredth("l_partkey").alias("m5"), hundredth("l_suppkey").alias("m3"), hundredth("l_orderkey").alias("sharp"), (F.col("l_linenumber") % 5 == 0).alias("split"), ((F.col("l_quantity") % 51) / 50.0).cast("double").alias("conf"))


@query("x09_composite", _SIGNALS + " select id, line, round(greatest(0, least(1, m5 * 0.15::double + m3 * 0.15::double + sharp * 0.15::double + conf * 0.15::double + 0.25 * conf + 0.1 * sharp + 0.05)), 9) as confidence from x")
def x09(spark, sf):
    x = _signals(spark, sf)
    parts = {"match_5p": F.col("m5"), "match_3p": F.col("m3"), "pos_5p": F.col("sharp"), "pos_3p": F.col("conf"), "persistence": F.col("conf"), "n_len": F.col("sharp"), "adapter_clean": F.lit(1.0)}
    return x.select("id", "line", F.round(I.composite(parts), 9).alias("confidence"))


@query("x10_combined_persistence", _SIGNALS + ", y as (select id, line, case when line % 2 = 0 then m5 end as a, case when line % 3 = 0 then m3 end as b from x) select id, line, coalesce((a + b) / 2, a, b) as persistence from y")
def x10(spark, sf):
    a, b = F.when(F.col("line") % 2 == 0, F.col("m5")), F.when(F.col("line") % 3 == 0, F.col("m3"))
    return _signals(spark, sf).select("id", "line", I.combined_persistence(a, b).alias("persistence"))


_MODE = """case when m5 < 0.4 and m3 < 0.4 then 'UNABLE_TO_EXTRACT' when split then 'PAIRED_END_SPLIT_PRIMERS' when m5 > 0.7 and m3 > 0.7 then 'BOTH_PRIMERS_SINGLE_READ' when m5 > 0.7 and sharp > 0.8 then 'FIVE_PRIME_ONLY' when m5 > 0.7 then 'UNABLE_TO_EXTRACT' when m3 > 0.7 and sharp > 0.8 then 'THREE_PRIME_ONLY' else 'UNABLE_TO_EXTRACT' end"""
_STATUS = "case when conf >= 0.85 then 'HIGH' when conf >= 0.6 then 'MEDIUM' when conf >= 0.3 then 'LOW' else 'UNABLE_TO_INFER' end"


@query(
    "x11_classification",
    _SIGNALS
    + f""", y as (select *, {_MODE} as extraction_mode, {_STATUS} as s from x) select id, line, extraction_mode, extraction_mode = 'BOTH_PRIMERS_SINGLE_READ' as full_insert,
    case extraction_mode when 'UNABLE_TO_EXTRACT' then 'MANUAL_PRIMERS_REQUIRED' when 'PAIRED_END_SPLIT_PRIMERS' then 'READ_MERGING_RECOMMENDED' else 'NONE' end as required_action,
    case when extraction_mode = 'UNABLE_TO_EXTRACT' then 'UNABLE_TO_INFER' else s end as status from y""",
)
def x11(spark, sf):
    call = I.classified(F.col("m5"), F.col("m3"), F.col("sharp"), F.col("split"), F.col("conf"), F.lit(True))
    return _signals(spark, sf).select("id", "line", call.alias("c")).select("id", "line", "c.*")


@query("x12_status", _SIGNALS + f" select id, line, case when {_STATUS} = 'HIGH' and line % 2 = 0 then 'MEDIUM' else {_STATUS} end as status from x")
def x12(spark, sf):
    return _signals(spark, sf).select("id", "line", I.status(F.col("conf"), F.col("line") % 2 != 0).alias("status"))


@query("x17_failure_reason", _SIGNALS + " select id, line, case when m5 = 0 then 'no candidate' else printf('%.2f', m5) end as reason from x")
def x17(spark, sf):
    return _signals(spark, sf).select("id", "line", F.when(F.col("m5") == 0, "no candidate").otherwise(F.printf(F.lit("%.2f"), F.col("m5"))).alias("reason"))


@query(
    "x15_library_report",
    f"select '{D.FIVE}' as primer_5p, '{D.THREE}' as primer_3p, 30 as n_length, 'FORWARD' as orientation, 'BOTH_PRIMERS_SINGLE_READ' as extraction_mode, true as full_insert, 'NONE' as required_action, 'HIGH' as status",
)
def x15(spark, sf):
    return I.library_report(D.reads(spark, sf)).select("primer_5p", "primer_3p", "n_length", "orientation", "extraction_mode", "full_insert", "required_action", "status")


@query("x13_zero_insert_guard", "select 'UNABLE_TO_EXTRACT' as extraction_mode, 'UNABLE_TO_INFER' as status")
def x13(spark, sf):
    one = D.reads(spark, sf).select("round", F.lit(D.FIVE + D.THREE + D.FIVE).alias("seq"))
    return I.library_report(one).select("extraction_mode", "status")


@query("x08_paired_split", f"select '{D.FIVE}' as primer_5p, '{D.THREE}' as primer_3p, 'PAIRED_END_SPLIT_PRIMERS' as extraction_mode")
def x08(spark, sf):
    from ..functions.sequences import reverse_complement

    r = D.reads(spark, sf)
    first = r.select("round", F.substring("seq", F.lit(1), F.length("seq") - 25).alias("seq"))
    return I.library_report(first, r.select("round", F.substring(reverse_complement(F.substring("seq", F.lit(1), F.length("seq"))), 1, 45).alias("seq"))).select("primer_5p", "primer_3p", "extraction_mode")
