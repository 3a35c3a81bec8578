"""Queries on scoring, agreement and synthetic outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import scoring as S
from ..registry import query
from . import derived as D

# Reports and truths made from orders: one accession for each order.
_ROWS = f"""rows_ as (select cast(o_orderkey as varchar) as accession, '{D.FIVE}' as truth_5p, '{D.THREE}' as truth_3p, o_orderkey % 5 <> 0 as score_3p, cast(30 + o_orderkey % 3 as integer) as truth_n,
case o_orderkey % 4 when 0 then 'insert_only' else 'raw' end as read_state, o_orderkey % 11 <> 0 as has_report,
case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then '{D.FIVE[:15]}' when o_orderkey % 7 = 2 then reverse(translate('{D.FIVE}', 'ACGT', 'TGCA')) when o_orderkey % 7 = 3 then translate('{D.FIVE}', 'T', 'U') when o_orderkey % 7 = 4 then 'TTTTTT' else '{D.FIVE}' end as primer_5p,
case when o_orderkey % 11 = 0 then null when o_orderkey % 6 = 0 then null when o_orderkey % 6 = 1 then '{D.THREE[5:]}' else '{D.THREE}' end as primer_3p,
case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 0 then 'HIGH' when o_orderkey % 3 = 1 then 'MEDIUM' else 'UNABLE_TO_INFER' end as status,
case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 2 then 'UNABLE_TO_EXTRACT' when o_orderkey % 2 = 0 then 'BOTH_PRIMERS_SINGLE_READ' else 'FIVE_PRIME_ONLY' end as extraction_mode,
case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 2 then 'MANUAL_PRIMERS_REQUIRED' else 'NONE' end as required_action,
case when o_orderkey % 11 = 0 then null else cast(30 + o_orderkey % 8 as integer) end as n_length from orders)"""


def _rows(spark, sf):
    from ..functions.sequences import reverse_complement

    k = F.col("o_orderkey")
    truth = D.table(spark, sf, "orders").select(
        k.cast("string").alias("accession"), F.lit(D.FIVE).alias("truth_5p"), F.lit(D.THREE).alias("truth_3p"), (k % 5 != 0).alias("score_3p"), (30 + k % 3).cast("int").alias("truth_n"), F.when(k % 4 == 0, "insert_only").otherwise("raw").alias("read_state")
    )
    five = F.when(k % 7 == 0, None).when(k % 7 == 1, D.FIVE[:15]).when(k % 7 == 2, reverse_complement(F.lit(D.FIVE))).when(k % 7 == 3, F.translate(F.lit(D.FIVE), "T", "U")).when(k % 7 == 4, "TTTTTT").otherwise(D.FIVE)
    reports = D.table(spark, sf, "orders").where(k % 11 != 0).select(
        k.cast("string").alias("accession"),
        five.alias("primer_5p"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, D.THREE[5:]).otherwise(D.THREE).alias("primer_3p"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("UNABLE_TO_INFER").alias("status"),
        F.when(k % 3 == 2, "UNABLE_TO_EXTRACT").when(k % 2 == 0, "BOTH_PRIMERS_SINGLE_READ").otherwise("FIVE_PRIME_ONLY").alias("extraction_mode"),
        F.when(k % 3 == 2, "MANUAL_PRIMERS_REQUIRED").otherwise("NONE").alias("required_action"),
        (30 + k % 8).cast("int").alias("n_length"),
    )
    return S.with_reports(truth, reports)


def _kind(o: str, t: str) -> str:
    ou, tu = f"translate({o}, 'U', 'T')", f"translate({t}, 'U', 'T')"
    return f"""case when {o} is null then 'MISMATCH' when {o} = {t} then 'EXACT' when {ou} = {tu} then 'U_T_NORMALIZED' when {ou} = reverse(translate({tu}, 'ACGT', 'TGCA')) then 'REVCOMP'
when starts_with({tu}, {ou}) or starts_with({ou}, {tu}) then 'PARTIAL_5P' when ends_with({tu}, {ou}) or ends_with({ou}, {tu}) then 'PARTIAL_3P' else 'MISMATCH' end"""


_KINDS = f"with {_ROWS}, k as (select *, {_kind('primer_5p', 'truth_5p')} as k5, {_kind('primer_3p', 'truth_3p')} as k3 from rows_)"


@query("j04_truth_reports", f"with {_ROWS} select accession, has_report, status, primer_5p from rows_")
def j04(spark, sf):
    return _rows(spark, sf).select("accession", "has_report", "status", "primer_5p")


@query("f14_equivalence", _KINDS + " select accession, k5, k3 from k")
def f14(spark, sf):
    return _rows(spark, sf).select("accession", S.equivalence(F.col("primer_5p"), F.col("truth_5p")).alias("k5"), S.equivalence(F.col("primer_3p"), F.col("truth_3p")).alias("k3"))


@query("f06_primers_agree", f"with {_ROWS} select accession, case when length(primer_5p) = length(truth_5p) then list_sum(list_transform(range(1, length(primer_5p) + 1), lambda i: case when substr(primer_5p, i, 1) = substr(truth_5p, i, 1) then 0 else 1 end)) <= 1 else contains(primer_5p, truth_5p) or contains(truth_5p, primer_5p) end as agree from rows_ where primer_5p is not null")
def f06(spark, sf):
    from ..functions.sequences import hamming

    a, b = F.col("primer_5p"), F.col("truth_5p")
    agree = F.when(F.length(a) == F.length(b), hamming(a, b) <= 1).otherwise(F.contains(a, b) | F.contains(b, a))
    return _rows(spark, sf).where("primer_5p is not null").select("accession", agree.alias("agree"))


@query(
    "a40_primer_recovery",
    _KINDS + """, e as (select coalesce(status, 'NO_REPORT') as status, '5p' as side, k5 as kind from k union all select coalesce(status, 'NO_REPORT'), '3p', k3 from k where score_3p)
    select side, status, kind, count(*) as n from e group by all union all select side, 'ALL', kind, count(*) from e group by side, kind""",
)
def a40(spark, sf):
    return S.primer_recovery(_rows(spark, sf))


_MATCH = "('EXACT', 'BARCODE_STRIPPED', 'U_T_NORMALIZED', 'REVCOMP')"


@query(
    "a41_pair_recovery",
    _KINDS + f""", p as (select coalesce(status, 'NO_REPORT') as status, k5 as a, case when score_3p then k3 else k5 end as b from k) select status,
    case when a = 'EXACT' and b = 'EXACT' then 'exact' when a in {_MATCH} and b in {_MATCH} then 'equivalent' when a in {_MATCH} or b in {_MATCH} or starts_with(a, 'PARTIAL') or starts_with(b, 'PARTIAL') then 'partial' else 'failed' end as bucket, count(*) as n from p group by all""",
)
def a41(spark, sf):
    return S.pair_recovery(_rows(spark, sf))


@query(
    "a42_safe_failures",
    f"""with {_ROWS} select 'no_library_report' as reason, count(*) as n from rows_ where not has_report union all select 'status_UNABLE_TO_INFER', count(*) from rows_ where status = 'UNABLE_TO_INFER'
    union all select 'extraction_mode_UNABLE_TO_EXTRACT', count(*) from rows_ where extraction_mode = 'UNABLE_TO_EXTRACT' union all select 'required_action_MANUAL_PRIMERS_REQUIRED', count(*) from rows_ where required_action = 'MANUAL_PRIMERS_REQUIRED'
    union all select 'any', count(*) from rows_ where not has_report or status = 'UNABLE_TO_INFER' or extraction_mode = 'UNABLE_TO_EXTRACT' or required_action = 'MANUAL_PRIMERS_REQUIRED' union all select 'evaluated', count(*) from rows_""",
)
def a42(spark, sf):
    return S.safe_failures(_rows(spark, sf))


@query("a43_action_distribution", f"with {_ROWS} select coalesce(required_action, 'NO_REPORT') as required_action, count(*) as n from rows_ group by 1")
def a43(spark, sf):
    return S.distribution(_rows(spark, sf), "required_action")


@query("a43_mode_distribution", f"with {_ROWS} select coalesce(extraction_mode, 'NO_REPORT') as extraction_mode, count(*) as n from rows_ group by 1")
def a43m(spark, sf):
    return S.distribution(_rows(spark, sf), "extraction_mode")


@query("a44_length_recovery", f"with {_ROWS} select case when coalesce(extraction_mode, '') <> 'BOTH_PRIMERS_SINGLE_READ' or n_length is null then 'unmeasurable' when abs(n_length - truth_n) <= 2 then 'in_tolerance' else 'out_of_tolerance' end as bucket, count(*) as n from rows_ group by 1")
def a44(spark, sf):
    return S.length_recovery(_rows(spark, sf))


@query("a45_no_false_calls", f"with {_ROWS} select read_state, count(*) filter (has_report) as n_evaluated, count(*) filter (has_report and primer_5p is null and primer_3p is null) as n_correct from rows_ group by read_state")
def a45(spark, sf):
    return S.no_false_calls(_rows(spark, sf))


def _pair(spark, sf):
    counts = C.unique_counts(D.inserts(spark, sf))
    one = lambda r: counts.where(F.col("round") == r).select("seq", "reads")
    return one(1), one(2)


_UNION = f"with {D.INSERTS}, x as (select coalesce(a.seq, b.seq) as seq, coalesce(a.reads, 0)::double as a, coalesce(b.reads, 0)::double as b from (select * from icounts where round = 1) a full join (select * from icounts where round = 2) b on a.seq = b.seq)"


@query(
    "a46_count_correlation",
    _UNION + """, r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from x), t as (select * from x order by b desc, seq limit 100)
    select count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman, (select round(corr(a, b), 6) from t) as pearson_top from r""",
)
def a46(spark, sf):
    return S.count_correlation(*_pair(spark, sf))


@query("j13_zero_filled_union", _UNION + " select seq, cast(a as bigint) as a, cast(b as bigint) as b from x")
def j13(spark, sf):
    one, two = _pair(spark, sf)
    return one.withColumnRenamed("reads", "a").join(two.withColumnRenamed("reads", "b"), "seq", "full").na.fill(0, ["a", "b"])


@query("w11_average_rank", _UNION + " select seq, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra from x")
def w11(spark, sf):
    one, two = _pair(spark, sf)
    x = one.withColumnRenamed("reads", "a").join(two.select("seq"), "seq", "full").na.fill(0, ["a"])
    return S.average_ranks(x, "a", "ra").select("seq", "ra")


_ARMS = "one as (select cast(doc_id as varchar) as accession, f as field, case when doc_id % 9 = 0 then null when f = 'quality' then quality else toxic end as value from labels, unnest(['quality', 'toxic']) t(f)), two as (select cast(doc_id as varchar) as accession, f as field, case when doc_id % 10 = 0 then null when doc_id % 13 = 0 then 1 - quality when f = 'quality' then quality else toxic end as value from labels, unnest(['quality', 'toxic']) t(f))"


def _arms(spark, sf):
    x = D.table(spark, sf, "labels").select(F.col("doc_id"), "quality", "toxic")
    cells = x.unpivot(["doc_id"], ["quality", "toxic"], "field", "value").join(x.select("doc_id", F.col("quality").alias("q")), "doc_id")
    k, acc = F.col("doc_id"), F.col("doc_id").cast("string").alias("accession")
    one = cells.select(acc, "field", F.when(k % 9 != 0, F.col("value")).alias("value"))
    return one, cells.select(acc, "field", F.when(k % 10 == 0, None).when(k % 13 == 0, 1 - F.col("q")).otherwise(F.col("value")).alias("value"))


@query(
    "a57_annotation_agreement",
    f"""with {_ARMS}, c as (select a.field, case when a.value is null and b.value is null then 'both_absent' when a.value is null or b.value is null then 'presence_mismatch' when a.value = b.value then 'agree' else 'disagree' end as call from one a join two b on a.accession = b.accession and a.field = b.field)
    select case when grouping(field) = 1 then 'ALL' else field end as field, count(*) as n, count(*) filter (call = 'agree') as agree, count(*) filter (call = 'disagree') as disagree, count(*) filter (call = 'presence_mismatch') as presence_mismatch, count(*) filter (call = 'both_absent') as both_absent,
    case when count(*) filter (call in ('agree', 'disagree')) > 0 then count(*) filter (call = 'agree') / count(*) filter (call in ('agree', 'disagree')) end as substantive_rate from c group by rollup(field)""",
)
def a57(spark, sf):
    return S.agreement(*_arms(spark, sf))


@query("a58_three_way", "with x as (select case when doc_id % 3 = 0 then null else quality end as a, case when doc_id % 4 = 0 then null else toxic end as b, case when doc_id % 5 = 0 then null else quality end as c from labels), y as (select list_filter([a, b, c], lambda v: v is not null) as v from x) select case when len(v) = 0 then 'none' when len(v) = 3 and len(list_distinct(v)) = 1 then 'all_agree' when len(v) = 2 and len(list_distinct(v)) = 1 then 'two_agree' when len(v) = 1 then 'single' else 'conflict' end as bucket, count(*) as n from y group by 1")
def a58(spark, sf):
    k = F.col("doc_id")
    x = D.table(spark, sf, "labels").select(F.when(k % 3 != 0, F.col("quality")).alias("a"), F.when(k % 4 != 0, F.col("toxic")).alias("b"), F.when(k % 5 != 0, F.col("quality")).alias("c"))
    return S.three_way(x)


@query("a59_doi_recall", "with t as (select page_id, concat('10.1000/', cast(page_id as varchar)) as doi from pages), f as (select page_id, concat('10.1000/', cast(page_id as varchar)) as doi from pages where page_id % 3 <> 0) select count(*) as n, count(f.doi) as n_recovered, count(f.doi) / count(*) as recall from t left join f on t.doi = f.doi")
def a59(spark, sf):
    t = D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("10.1000/"), F.col("page_id").cast("string")).alias("doi"))
    x = t.join(t.where("page_id % 3 <> 0").select("doi", F.lit(1).alias("found")), "doi", "left")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("n_recovered"), (F.count("found") / F.count(F.lit(1))).alias("recall"))


_SYN = """syn as (select o_orderkey as id, o_orderpriority as config, o_orderkey % 6 = 0 as control, case when o_orderkey % 17 = 0 then null when o_orderkey % 3 = 0 then 'UNABLE_TO_INFER' else 'HIGH' end as status,
case o_orderkey % 4 when 0 then 'wrong' when 1 then 'partial' else 'complete' end as five, case o_orderkey % 5 when 0 then 'partial' else 'complete' end as three from orders),
out_ as (select *, case when status is null then 'error' when control and status = 'UNABLE_TO_INFER' then 'control_refused' when control then 'wrong' when status = 'UNABLE_TO_INFER' then 'refused' when five = 'wrong' or three = 'wrong' then 'wrong' when five = 'complete' and three = 'complete' then 'complete' else 'partial' end as outcome from syn)"""


def _synthetic(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 17 == 0, None).when(k % 3 == 0, "UNABLE_TO_INFER").otherwise("HIGH")
    five = F.when(k % 4 == 0, "wrong").when(k % 4 == 1, "partial").otherwise("complete")
    three = F.when(k % 5 == 0, "partial").otherwise("complete")
    x = D.table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("config"), (k % 6 == 0).alias("control"), status.alias("status"), five.alias("five"), three.alias("three"))
    return x.withColumn("outcome", S.run_outcome(F.col("status"), F.col("five"), F.col("three"), F.col("control")))


@query("b05_run_outcome", f"with {_SYN} select id, outcome from out_")
def b05(spark, sf):
    return _synthetic(spark, sf).select("id", "outcome")


_NAMES = ("complete", "partial", "refused", "wrong", "error", "control_refused")


@query(
    "a56_outcome_summary",
    f"with {_SYN}, s as (select config, {', '.join(f'''count(*) filter (outcome = '{n}') as {n}''' for n in _NAMES)} from out_ group by config) select *, (complete + partial + wrong) / (complete + partial + wrong + refused + error) as coverage, (complete + partial) / (complete + partial + wrong) as accuracy from s",
)
def a56(spark, sf):
    return S.outcome_summary(_synthetic(spark, sf), "config")


@query("a64_stratified_shares", f"with {_SYN} select coalesce(status, 'none') as status, count(*) filter (outcome = 'complete') / count(*) as complete_share, count(*) filter (outcome = 'wrong') / count(*) as wrong_share from out_ group by 1")
def a64(spark, sf):
    share = lambda n: (F.count_if(F.col("outcome") == n) / F.count(F.lit(1))).alias(f"{n}_share")
    return _synthetic(spark, sf).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(share("complete"), share("wrong"))


@query("f32_call_category", f"with {_ROWS} select accession, case when primer_5p is null then 'none' when primer_5p = truth_5p then 'complete' when contains(truth_5p, primer_5p) then 'partial' else 'wrong' end as category from rows_")
def f32(spark, sf):
    return _rows(spark, sf).select("accession", S.call_category(F.col("primer_5p"), F.col("truth_5p")).alias("category"))


@query("a55_read_metrics", f"with {D.READS}, t as (select distinct rec, rec % 4 <> 0 as on_target, rec % 5 <> 0 as emitted, rec % 7 <> 0 as same from reads) select count(*) filter (emitted and on_target) / count(*) filter (emitted) as precision, count(*) filter (emitted and on_target) / count(*) filter (on_target) as recall, count(*) filter (emitted and on_target and same) / count(*) filter (emitted and on_target) as n_recovery from t")
def a55(spark, sf):
    r = D.reads(spark, sf).groupBy("rec").agg(F.min("seq").alias("seq"))
    truth = r.select(F.col("rec").alias("name"), F.col("seq").alias("insert"), (F.col("rec") % 4 != 0).alias("on_target"))
    emitted = r.where("rec % 5 <> 0").select(F.col("rec").alias("name"), F.when(F.col("rec") % 7 != 0, F.col("seq")).otherwise("x").alias("seq"))
    return S.read_metrics(truth, emitted)


@query("a63_recovery_totals", f"with {D.READS}, y as (select round, count(*) filter (seq like '%CCATGCATGCATGCATGCAT') / count(*) as kept from reads group by round) select min(kept) as lowest_yield, count(*) filter (kept >= 0.9) as n_good from y")
def a63(spark, sf):
    by = D.reads(spark, sf).groupBy("round").agg((F.count_if(F.col("seq").endswith(D.THREE)) / F.count(F.lit(1))).alias("kept"))
    return by.agg(F.min("kept").alias("lowest_yield"), F.count_if(F.col("kept") >= 0.9).alias("n_good"))
