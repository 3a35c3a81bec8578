"""Queries on run metadata, rounds, studies and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import metadata as M
from ..registry import query
from . import derived as D

_BLOCKED = ", ".join(f"'{s}'" for s in M.BLOCKED_STRATEGIES)
_OK = f"(trim(library_strategy) = '' or trim(library_strategy) not in ({_BLOCKED}))"


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


_CANDIDATES = ", ".join(f"list_transform(regexp_extract_all(sample_title, '{_sql_pattern(p)}', 1), lambda x: {{'p': '{name}', 'r': cast(x as integer)}})" for name, p in M.ROUND_PATTERNS)
ROUNDS = (
    D.RUNS
    + f""", cand as (select *, flatten([{_CANDIDATES}]) as f from runs),
rounds as (select srr, bioproject_id, sample_title, library_strategy, sample_accession, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: y.r), x.r) = i) as c from cand),
parsed as (select srr, bioproject_id, sample_title, library_strategy, sample_accession, case when len(c) > 0 then c[1].r end as round_number, case when len(c) = 1 then 'HIGH' when len(c) > 1 then 'MEDIUM' else 'NONE' end as confidence,
case when len(c) > 0 then 'sample_title' else 'none' end as source_field, case when len(c) > 0 then c[1].p else 'none' end as matched_pattern, list_transform(c, lambda x: x.r) as round_candidates from rounds)"""
)
_ASSIGNED = "(round_number is not null and len(round_candidates) <= 1)"


def _parsed(spark, sf):
    return M.parse_rounds(D.runs(spark, sf))


@query("p02_catalogue_filter", f"with {D.RUNS} select srr from runs where regexp_matches(sample_title, '(?i)r[0-9]') and regexp_matches(library_strategy, '(?i)seq|selex') and regexp_matches(bioproject_id, '{M.INSDC}')")
def p02(spark, sf):
    x = D.runs(spark, sf).select("srr", "bioproject_id", F.col("sample_title").alias("protein_target"), F.col("library_strategy").alias("organism"))
    return M.filter_catalogue(x, target="r[0-9]", organism="seq|selex", insdc_only=True).select("srr")


@query("p03_insdc", "select page_id, regexp_matches(concat(case page_id % 4 when 0 then 'PRJNA' when 1 then 'SRP' when 2 then 'zenodo:' else 'GSE' end, cast(page_id as varchar)), '" + M.INSDC + "') as insdc from pages")
def p03(spark, sf):
    return _ids(spark, sf).select("page_id", M.is_insdc(F.col("id")).alias("insdc"))


def _ids(spark, sf):
    p = F.col("page_id")
    head = F.when(p % 4 == 0, "PRJNA").when(p % 4 == 1, "SRP").when(p % 4 == 2, "zenodo:").otherwise("GSE")
    return D.table(spark, sf, "pages").select("page_id", F.concat(head, p.cast("string")).alias("id"))


@query("p04_discovery_only", "select page_id, page_id % 4 = 2 as discovery from pages")
def p04(spark, sf):
    return _ids(spark, sf).select("page_id", M.is_discovery_only(F.col("id")).alias("discovery"))


@query("p05_catalogue_list", f"with {D.RUNS} select bioproject_id, case when regexp_matches(bioproject_id, '{M.INSDC}') then 'yes' else 'no' end as fetchable, count(*) as n from runs group by all order by bioproject_id limit 20")
def p05(spark, sf):
    fetchable = F.when(M.is_insdc(F.col("bioproject_id")), "yes").otherwise("no").alias("fetchable")
    return D.runs(spark, sf).groupBy("bioproject_id", fetchable).agg(F.count(F.lit(1)).alias("n")).orderBy("bioproject_id").limit(20)


@query("p06_catalogue_lookup", f"with {D.RUNS} select field, value from (select * from runs where srr = 'SRR00000007') unpivot (value for field in (srr, bioproject_id, sample_title, library_strategy)) where value <> ''")
def p06(spark, sf):
    columns = ["srr", "bioproject_id", "sample_title", "library_strategy"]
    return D.runs(spark, sf).where("srr = 'SRR00000007'").unpivot([], columns, "field", "value").where("value <> ''")


@query("p07_strategy", f"with {D.RUNS} select srr, {_OK} as ok from runs")
def p07(spark, sf):
    return D.runs(spark, sf).select("srr", M.compatible_strategy(F.col("library_strategy")).alias("ok"))


@query(
    "p08_blacklist",
    """select doc_id, doc_id in (3, 5) or contains(lower(source), 'src7') or regexp_matches(lower(text), '(?s)\\bthe\\b.{0,200}(?:selex|aptamer|riboswitch)|(?:selex|aptamer|riboswitch).{0,200}\\bthe\\b')
    or ((contains(lower(text), 'whole cell') or contains(lower(text), 'differential cell selex')) and source = '') as listed from documents""",
)
def p08(spark, sf):
    listed = M.blacklisted(F.col("doc_id").cast("string"), F.col("source"), F.col("text"), ["3", "5"], ["src7"], 0)
    return D.table(spark, sf, "documents").select("doc_id", (listed | M.sm_in_context(F.col("text"), ["the"])).alias("listed"))


@query("p09_included", "select o_orderkey, lower(trim(substr(o_orderstatus, 1, 1))) = 'f' as included from orders")
def p09(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", M.included(F.translate(F.lower("o_orderstatus"), "fy", "yz")).alias("included"))


@query("p10_unassigned", f"with {ROUNDS} select srr, not {_ASSIGNED} as unassigned from parsed")
def p10(spark, sf):
    return _parsed(spark, sf).select("srr", M.is_unassigned().alias("unassigned"))


@query("p11_trusted", f"with {ROUNDS} select srr, {_ASSIGNED} and confidence in ('HIGH', 'MEDIUM') as trusted from parsed")
def p11(spark, sf):
    return _parsed(spark, sf).select("srr", M.is_trusted().alias("trusted"))


@query("p12_truthy", "with x as (select unnest(['true', ' YES', '1', 'y', 'no', '', 'True ', '0']) as cell) select cell, lower(trim(cell)) in ('true', '1', 'yes', 'y') as truthy from x")
def p12(spark, sf):
    x = spark.createDataFrame([(c,) for c in ("true", " YES", "1", "y", "no", "", "True ", "0")], "cell string")
    return x.select("cell", M.truthy(F.col("cell")).alias("truthy"))


@query("p14_parsed_int", "select o_orderkey, case when o_orderkey % 3 = 0 then -o_orderkey when o_orderkey % 3 = 1 then o_orderkey end as n from orders")
def p14(spark, sf):
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, (-k).cast("string")).when(k % 3 == 1, F.concat(F.lit(" "), k.cast("string"))).otherwise("n/a")
    return D.table(spark, sf, "orders").select("o_orderkey", M.parsed_int(cell).alias("n"))


@query("p16_hashable", "select page_id, page_id % 3 <> 2 as hashable from pages")
def p16(spark, sf):
    from ..sources.tables import hashable

    p = F.col("page_id")
    name = F.concat(F.lit("out/r"), p.cast("string"), F.when(p % 3 == 0, ".fasta.gz").when(p % 3 == 1, ".yaml").otherwise(".parquet"))
    return D.table(spark, sf, "pages").select("page_id", hashable(name).alias("hashable"))


@query("m01_round_cascade", f"with {ROUNDS} select srr, round_number, confidence, source_field, matched_pattern, array_to_string(round_candidates, ',') as candidates from parsed")
def m01(spark, sf):
    x = _parsed(spark, sf)
    return x.select("srr", "round_number", "confidence", "source_field", "matched_pattern", F.array_join(F.col("round_candidates").cast("array<string>"), ",").alias("candidates"))


@query("m01_round_attributes", "select * from (values (1, 3, 'HIGH'), (2, 2, 'MEDIUM'), (3, 3, 'HIGH'), (4, 25, 'MEDIUM'), (5, null, 'NONE')) t(id, round_number, confidence)")
def m01a(spark, sf):
    rows = [(1, "", {"selex cycle": "3", "pcr cycle": "25"}), (2, "", {"round": "2", "selex cycle": "R3"}), (3, "Round 3", {"pcr cycle": "25"}), (4, "", {"pcr cycle": "25"}), (5, "", {"cell cycle": "2"})]
    x = spark.createDataFrame(rows, "id int, sample_title string, attributes map<string,string>")
    return M.parse_rounds(x, attributes="attributes").select("id", "round_number", "confidence")


@query("m02_seed_override", f"with {ROUNDS} select srr, case when srr in ('SRR00000003', 'SRR00000004') then 9 else round_number end as round_number, case when srr in ('SRR00000003', 'SRR00000004') then 'HIGH' else confidence end as confidence from parsed")
def m02(spark, sf):
    seeds = spark.createDataFrame([("SRR00000003", 9), ("SRR00000004", 9)], "srr string, round int")
    return M.seeded(_parsed(spark, sf), seeds).select("srr", "round_number", "confidence")


@query("m03_fetch_plan", f"with {D.RUNS} select srr, cast(1 + length(sample_title) % 2 as integer) as n_urls, length(sample_title) % 2 = 1 as paired_end from runs")
def m03(spark, sf):
    two = F.length("sample_title") % 2 == 1
    urls = F.when(two, "ftp/a_1.fastq.gz; ftp/a_2.fastq.gz").otherwise("ftp/a.fastq.gz;")
    x = D.runs(spark, sf).select("srr", urls.alias("fastq_ftp"), F.lit("x;y").alias("fastq_md5"), F.lit("12;bad").alias("fastq_bytes"))
    return M.fetch_plan(x).select("srr", F.size("fastq_urls").alias("n_urls"), "paired_end")


@query("m05_sentinel", f"with {D.RUNS} select srr, case when trim(library_strategy) = '' then 'not_assessed_v0.1' else library_strategy end as library_type from runs")
def m05(spark, sf):
    return D.runs(spark, sf).select("srr", M.sentinel(F.col("library_strategy")).alias("library_type"))


@query(
    "m06_catalogue_rebuild",
    f"""with {D.RUNS}, k as (select bioproject_id, count(*) as n_runs, count(*) filter ({_OK}) as n_ok from runs where md5(srr) <= 'c' group by bioproject_id having count(*) filter ({_OK}) > 0),
    o as (select concat('zenodo:', cast(page_id as varchar)) as id from pages where page_id % 7 = 0) select bioproject_id, cast(n_runs as bigint) as n_runs from k union all select id, 0 from o""",
)
def m06(spark, sf):
    runs = M.first_row(D.runs(spark, sf).where("md5(srr) <= 'c'").unionByName(D.runs(spark, sf).where("md5(srr) <= '2'")), "srr", ["srr"])
    kept = M.study_strategies(runs).where(~F.col("exclude")).select("bioproject_id", "n_runs")
    old = D.table(spark, sf, "pages").where("page_id % 7 = 0").select(F.concat(F.lit("zenodo:"), F.col("page_id").cast("string")).alias("bioproject_id"), F.lit(0).cast("long").alias("n_runs"))
    return kept.unionByName(M.passthrough(old.unionByName(kept), kept))


@query("m07_fetch_decision", f"with {ROUNDS} select bioproject_id, count(*) filter ({_ASSIGNED}) as n_assigned, count(*) filter (not {_ASSIGNED}) as n_unassigned, case when count(*) filter ({_ASSIGNED}) = 0 then 'refuse' when count(*) filter (not {_ASSIGNED}) > 0 then 'partial' else 'fetch' end as decision from parsed group by bioproject_id")
def m07(spark, sf):
    return M.fetch_decision(_parsed(spark, sf))


@query("m08_inspect", f"with {ROUNDS} select bioproject_id, count(*) as n_runs, count(distinct round_number) as n_rounds, min(srr) as first_srr from parsed group by bioproject_id")
def m08(spark, sf):
    return _parsed(spark, sf).groupBy("bioproject_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("round_number").alias("n_rounds"), F.min("srr").alias("first_srr"))


@query("m10_enrichment_index", f"with {D.RUNS} select srr from runs where trim(sample_title) <> '' or trim(library_strategy) <> ''")
def m10(spark, sf):
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return D.runs(spark, sf).where(filled("sample_title") | filled("library_strategy")).select("srr")


@query("f16_round_of_title", f"with {ROUNDS} select sample_title, max(round_number) as round_number, count(*) as n from parsed group by sample_title")
def f16(spark, sf):
    return _parsed(spark, sf).groupBy("sample_title").agg(F.max("round_number").alias("round_number"), F.count(F.lit(1)).alias("n"))


@query("f17_attribute_key", "select * from (values ('Characteristics[Selex Cycle]', 'HIGH'), ('selection-round', 'HIGH'), ('pcr cycle', 'MEDIUM'), ('cell cycle', null), ('round of selex enrichment', 'HIGH'), ('cycle threshold', null)) t(key, confidence)")
def f17(spark, sf):
    keys = ["Characteristics[Selex Cycle]", "selection-round", "pcr cycle", "cell cycle", "round of selex enrichment", "cycle threshold"]
    return spark.createDataFrame([(k,) for k in keys], "key string").select("key", M.attribute_confidence(F.col("key")).alias("confidence"))


@query("f18_target_hint", f"with {D.RUNS} select distinct sample_title, nullif(regexp_extract(sample_title, '^([A-Z][A-Za-z0-9_\\-]+)[\\s_\\-]+(?:[Rr]ound|[Rr][0-9]|[Cc]ycle)', 1), '') as hint from runs")
def f18(spark, sf):
    return D.runs(spark, sf).select("sample_title", M.target_hint(F.col("sample_title")).alias("hint")).distinct()


@query("f19_abstract_rounds", "select * from (values ('after 8 rounds of selection', 8), ('rounds 1 through 6', 6), ('R0 to R5', 5), ('twelve cycles, 12 selection cycles', 12), ('none', null)) t(abstract, n)")
def f19(spark, sf):
    texts = ["after 8 rounds of selection", "rounds 1 through 6", "R0 to R5", "twelve cycles, 12 selection cycles", "none"]
    return spark.createDataFrame([(t,) for t in texts], "abstract string").select("abstract", M.abstract_rounds(F.col("abstract")).alias("n"))


@query("f31_metadata_tier", f"with {D.RUNS} select srr, coalesce(nullif(trim(sample_title), ''), nullif(trim(library_strategy), ''), 'unknown') as label, case when trim(sample_title) <> '' then 1 when trim(library_strategy) <> '' then 2 else 3 end as tier from runs")
def f31(spark, sf):
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in ("sample_title", "library_strategy"))
    return D.runs(spark, sf).select("srr", F.coalesce(a, b, F.lit("unknown")).alias("label"), F.when(a.isNotNull(), 1).when(b.isNotNull(), 2).otherwise(3).alias("tier"))


@query("a31_study_strategies", f"with {D.RUNS} select bioproject_id, count(*) as n_runs, count(*) filter ({_OK}) as n_compatible, count(*) filter (not {_OK}) as n_blocked, count(*) filter ({_OK}) = 0 as exclude, count(*) filter ({_OK}) > 0 and count(*) filter (not {_OK}) > 0 as mixed from runs group by bioproject_id")
def a31(spark, sf):
    return M.study_strategies(D.runs(spark, sf))


@query("a31_strategy_map", f"with {D.RUNS}, x as (select bioproject_id, library_strategy, count(*) as n from runs group by all) select bioproject_id, string_agg(concat(library_strategy, '=', cast(n as varchar)), ',' order by library_strategy) as strategies from x group by bioproject_id")
def a31m(spark, sf):
    entries = F.transform(F.map_entries("strategies"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return M.strategy_map(D.runs(spark, sf)).select("bioproject_id", F.array_join(entries, ",").alias("strategies"))


_HIST = "count(*) filter (confidence = 'HIGH') as n_high, count(*) filter (confidence = 'MEDIUM') as n_medium, count(*) filter (confidence = 'NONE') as n_none"


@query("a32_confidence_histogram", f"with {ROUNDS} select bioproject_id, {_HIST} from parsed group by bioproject_id")
def a32(spark, sf):
    return M.confidence_histogram(_parsed(spark, sf))


_COVER = f"""with {ROUNDS}, p as (select bioproject_id, case when cast(substr(bioproject_id, 6) as integer) % 4 = 0 then null when cast(substr(bioproject_id, 6) as integer) % 4 = 1 then 2 else 12 end as declared, cast(substr(bioproject_id, 6) as integer) % 3 = 0 as hint from (select distinct bioproject_id from runs)),
s as (select bioproject_id, count(*) as n_srr, count(distinct round_number) as n_seen, count(*) filter (round_number is null) as n_unknown from parsed group by bioproject_id),
c as (select p.bioproject_id, n_srr, n_seen, n_unknown, case when declared is null and hint then 'rounds_multiplexed_unrecoverable' when declared is null then 'unknown_round_coverage' when n_seen >= declared then 'all_rounds_public' when hint then 'rounds_multiplexed_unrecoverable' when n_unknown > 0 then 'unknown_round_coverage' else 'partial_rounds_public' end as round_coverage_status from p join s on p.bioproject_id = s.bioproject_id)"""


def _coverage(spark, sf):
    rounds = _parsed(spark, sf)
    k = F.substring("bioproject_id", 6, 9).cast("int")
    projects = rounds.select("bioproject_id").distinct().select(
        "bioproject_id", F.when(k % 4 == 0, "").when(k % 4 == 1, "2").otherwise("12").alias("n_rounds_declared"), F.when(k % 3 == 0, "Pooled rounds").alias("notes"), F.lit("").alias("title")
    )
    return M.round_coverage(projects, rounds)


@query("a33_round_coverage", _COVER + " select * from c")
def a33(spark, sf):
    return _coverage(spark, sf).drop("reason")


@query("a34_coverage_summary", _COVER + " select round_coverage_status, count(*) as n from c group by round_coverage_status")
def a34(spark, sf):
    return M.coverage_summary(_coverage(spark, sf))


@query("a35_round_summary", f"with {ROUNDS} select bioproject_id, {_HIST}, bool_or(len(round_candidates) > 1) as inconsistent from parsed group by bioproject_id")
def a35(spark, sf):
    return M.round_summary(_parsed(spark, sf))


@query("a36_shared_rounds", f"with {ROUNDS} select bioproject_id, round_number, count(distinct sample_accession) as n_samples from parsed where {_ASSIGNED} group by all having count(distinct sample_accession) > 1")
def a36(spark, sf):
    return M.shared_rounds(_parsed(spark, sf))


_ELIG = f"""with {ROUNDS}, e as (select bioproject_id, count(*) as n_runs, count(*) filter ({_OK}) as n_compatible, count(*) filter ({_OK} and round_number is not null) as n_with_round, count(distinct case when {_OK} then round_number end) as n_rounds,
greatest(1, count(distinct case when {_OK} then regexp_replace(trim(sample_title), '[0-9]+', '{{N}}', 'g') end)) as n_groups from parsed group by bioproject_id),
el as (select *, case when n_compatible = 0 then 'NON_SELEX_ASSAY' when n_with_round < 2 or n_rounds < 2 then 'NO_ROUND_STRUCTURE' when n_compatible < n_runs or n_groups >= 2 then 'MIXED_PROJECT_NEEDS_GROUPING' else 'ELIGIBLE_HT_SELEX_ROUNDS' end as classification from e)"""


@query("a37_eligibility", _ELIG + " select * from el")
def a37(spark, sf):
    return M.eligibility(_parsed(spark, sf))


@query("a38_library_groups", f"with {D.RUNS} select bioproject_id, greatest(1, count(distinct regexp_replace(trim(sample_title), '[0-9]+', '{{N}}', 'g'))) as n_groups from runs group by bioproject_id")
def a38(spark, sf):
    return D.runs(spark, sf).groupBy("bioproject_id").agg(F.greatest(F.lit(1), F.count_distinct(M.library_group(F.col("sample_title")))).alias("n_groups"))


@query("a39_classification_distribution", _ELIG + " select classification, count(*) as n from el group by classification")
def a39(spark, sf):
    return M.eligibility(_parsed(spark, sf)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query("a62_round_validation", f"with {ROUNDS} select count(*) as n_runs, count(*) filter ({_ASSIGNED}) as n_assigned, count(distinct bioproject_id) as n_deposits from parsed")
def a62(spark, sf):
    return _parsed(spark, sf).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(~M.is_unassigned()).alias("n_assigned"), F.count_distinct("bioproject_id").alias("n_deposits"))


@query("j02_sample_rounds", f"with {ROUNDS} select r.bioproject_id, count(*) as n, count(p.round_number) as n_round from runs r left join (select * from parsed where md5(srr) < '6') p on r.srr = p.srr group by r.bioproject_id")
def j02(spark, sf):
    some = _parsed(spark, sf).where("md5(srr) < '6'").select("srr", "round_number")
    return D.runs(spark, sf).join(some, "srr", "left").groupBy("bioproject_id").agg(F.count(F.lit(1)).alias("n"), F.count("round_number").alias("n_round"))


@query("j03_sample_attributes", "select o.o_orderkey, coalesce(c.c_mktsegment, '{}') as attributes from orders o left join (select * from customer where c_custkey % 2 = 0) c on o.o_custkey = c.c_custkey")
def j03(spark, sf):
    c = D.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return D.table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("{}")).alias("attributes"))


@query("j06_enrich", f"with {D.RUNS} select a.srr, coalesce(nullif(trim(a.sample_title), ''), b.t, '') as sample_title from runs a left join (select srr, concat('old ', srr) as t from runs where md5(srr) < '8') b on a.srr = b.srr")
def j06(spark, sf):
    r = D.runs(spark, sf).select("srr", "sample_title")
    old = r.where("md5(srr) < '8'").withColumn("sample_title", F.concat(F.lit("old "), F.col("srr")))
    return M.enriched(r, old, ["sample_title"], "srr")


@query("j07_passthrough", "select concat('zenodo:', cast(page_id as varchar)) as bioproject_id from pages where page_id % 4 = 2 and page_id % 8 <> 2")
def j07(spark, sf):
    ids = _ids(spark, sf)
    return M.passthrough(ids.select(F.col("id").alias("bioproject_id")), ids.where("page_id % 8 = 2").select(F.col("id").alias("bioproject_id")))


@query("j08_missing_samples", f"with {D.RUNS} select distinct bioproject_id from runs where bioproject_id not in (select bioproject_id from runs where md5(bioproject_id) < 'c')")
def j08(spark, sf):
    r = D.runs(spark, sf)
    return r.select("bioproject_id").distinct().join(r.where("md5(bioproject_id) < 'c'").select("bioproject_id"), "bioproject_id", "left_anti")


@query("j12_curated_rounds", f"with {ROUNDS}, c as (select srr, cast(length(sample_title) % 5 as integer) as cur from runs where md5(srr) < '9') select case when c.cur is null then 'not_curated' when p.round_number is null then 'missing' when p.round_number = c.cur then 'agree' else 'differ' end as outcome, count(*) as n from parsed p left join c on p.srr = c.srr group by 1")
def j12(spark, sf):
    p = _parsed(spark, sf)
    c = p.where("md5(srr) < '9'").select("srr", (F.length("sample_title") % 5).alias("cur"))
    outcome = F.when(F.col("cur").isNull(), "not_curated").when(F.col("round_number").isNull(), "missing").when(F.col("round_number") == F.col("cur"), "agree").otherwise("differ")
    return p.join(c, "srr", "left").select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("j22_completeness", f"with {D.RUNS}, k as (select distinct bioproject_id from runs), h as (select distinct bioproject_id from runs where md5(bioproject_id) < '8') select count(*) as n_all, count(h.bioproject_id) as n_present, round(100.0::double * count(h.bioproject_id) / count(*), 6) as percent from k left join h on k.bioproject_id = h.bioproject_id")
def j22(spark, sf):
    r = D.runs(spark, sf)
    have = r.where("md5(bioproject_id) < '8'").select("bioproject_id").distinct().withColumn("here", F.lit(1))
    x = r.select("bioproject_id").distinct().join(have, "bioproject_id", "left")
    return x.agg(F.count(F.lit(1)).alias("n_all"), F.count("here").alias("n_present"), F.round(100.0 * F.count("here") / F.count(F.lit(1)), 6).alias("percent"))


@query("w13_first_filled", f"with {D.RUNS} select bioproject_id, coalesce(arg_min(sample_title, srr) filter (trim(sample_title) <> ''), '') as sample_title, coalesce(arg_min(library_strategy, srr) filter (trim(library_strategy) <> ''), '') as library_strategy from runs group by bioproject_id")
def w13(spark, sf):
    return M.first_filled(D.runs(spark, sf), "bioproject_id", "srr", ["sample_title", "library_strategy"])


@query("w14_first_wins", f"with {D.RUNS} select bioproject_id, srr from (select *, row_number() over (partition by bioproject_id order by srr) as k from runs) where k = 1")
def w14(spark, sf):
    return M.first_row(D.runs(spark, sf), "bioproject_id", ["srr"]).select("bioproject_id", "srr")


@query("w16_trajectory_choice", f"with {ROUNDS}, t as (select sample_accession, count(distinct round_number) as n, min(srr) as first from parsed group by sample_accession) select sample_accession, n, first from t order by n desc, first limit 1")
def w16(spark, sf):
    by = _parsed(spark, sf).groupBy("sample_accession").agg(F.count_distinct("round_number").alias("n"), F.min("srr").alias("first"))
    return by.orderBy(F.desc("n"), "first").limit(1)


@query("e03_set_differences", f"with {D.RUNS}, a as (select distinct bioproject_id from runs where md5(bioproject_id) < '9'), b as (select distinct bioproject_id from runs where md5(bioproject_id) > '5' and md5(bioproject_id) < 'd') select 'both' as side, count(*) as n from (select * from a intersect select * from b) union all select 'left', count(*) from (select * from a except select * from b) union all select 'right', count(*) from (select * from b except select * from a)")
def e03(spark, sf):
    ids = D.runs(spark, sf)
    a = ids.where("md5(bioproject_id) < '9'").select("bioproject_id")
    b = ids.where("md5(bioproject_id) > '5' and md5(bioproject_id) < 'd'").select("bioproject_id")
    n = lambda x, side: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "left")).unionByName(n(b.subtract(a), "right"))


@query("e04_union_first_wins", f"with {D.RUNS} select srr, 1 as source from runs where md5(srr) < '6' union all select srr, 2 from runs where md5(srr) >= '6' and md5(srr) < 'c'")
def e04(spark, sf):
    r = D.runs(spark, sf).select("srr")
    rows = r.where("md5(srr) < '6'").withColumn("source", F.lit(1)).unionByName(r.where("md5(srr) < 'c'").withColumn("source", F.lit(2)))
    return M.first_row(rows, "srr", ["source"])


@query("e06_sampling_pool", _ELIG + " select bioproject_id from el where classification <> 'NON_SELEX_ASSAY' and bioproject_id not in ('PRJNA1', 'PRJNA2')")
def e06(spark, sf):
    out = spark.createDataFrame([("PRJNA1",), ("PRJNA2",)], "bioproject_id string")
    pool = M.eligibility(_parsed(spark, sf)).where("classification <> 'NON_SELEX_ASSAY'").select("bioproject_id")
    return pool.where(M.is_insdc(F.col("bioproject_id"))).join(F.broadcast(out), "bioproject_id", "left_anti")


@query("b02_remaining_stages", f"with {D.RUNS}, w as (select distinct bioproject_id as dataset, s as stage from runs, unnest(['fetch', 'detect', 'extract', 'count', 'qc']) as t(s)) select dataset, stage from w where not (cast(substr(dataset, 6) as integer) % 2 = 0 and stage in ('fetch', 'detect'))")
def b02(spark, sf):
    sets = D.runs(spark, sf).select(F.col("bioproject_id").alias("dataset")).distinct()
    wanted = sets.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in B.STAGES])))
    done = wanted.where((F.substring("dataset", 6, 9).cast("int") % 2 == 0) & F.col("stage").isin("fetch", "detect"))
    return B.remaining(wanted, done)


@query("b03_sampled_corpus")
def b03(spark, sf):
    return B.sampled(D.runs(spark, sf).select("bioproject_id").distinct(), "bioproject_id", 23)
