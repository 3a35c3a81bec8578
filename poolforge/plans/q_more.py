"""Further joins, tables and composites of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import extraction as X
from ..operators import metadata as M
from ..operators import qc as Q
from ..operators import scoring as S
from ..operators import trimming as T
from ..registry import query
from . import derived as D
from .q_metadata import _ASSIGNED, _ELIG, ROUNDS, _parsed
from .q_qc import _JACC, _TOPK
from .q_scoring import _ROWS, _rows


@query("t04_paired_trim", f"with {D.READS} select rec, substr(seq, length(seq) - 49) as seq, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 21) as mate_seq from reads")
def t04(spark, sf):
    from ..functions.sequences import rc, reverse_complement

    pairs = D.reads(spark, sf).where(F.col("seq").endswith(D.THREE) | F.col("seq").endswith(D.THREE_VARIANT)).select("rec", "seq", reverse_complement(F.col("seq")).alias("mate_seq"))
    return T.paired_trim(pairs, D.FIVE, rc(D.THREE))


@query("t12_barcode_pairs", "with b(i, code) as (values (1, 'ATTGT'), (2, 'CTGAG'), (5, 'CCGCC'), (7, 'GACAT')) select a.i as a, b.i as b, cast(list_sum(list_transform(range(1, 6), lambda k: case when substr(a.code, k, 1) = substr(b.code, k, 1) then 0 else 1 end)) as integer) as d from b a join b b on a.i < b.i")
def t12(spark, sf):
    from ..functions.sequences import hamming

    b = spark.createDataFrame([(1, "ATTGT"), (2, "CTGAG"), (5, "CCGCC"), (7, "GACAT")], "i int, code string")
    x, y = b.select(F.col("i").alias("a"), F.col("code").alias("x")), b.select(F.col("i").alias("b"), F.col("code").alias("y"))
    return x.join(F.broadcast(y), F.col("a") < F.col("b")).select("a", "b", hamming(F.col("x"), F.col("y")).alias("d"))


@query("t17_countable_mode", f"with {_ROWS} select accession, coalesce(extraction_mode, '') in ('BOTH_PRIMERS_SINGLE_READ', 'FIVE_PRIME_ONLY', 'THREE_PRIME_ONLY') as countable from rows_")
def t17(spark, sf):
    return _rows(spark, sf).select("accession", X.countable(F.col("extraction_mode")).alias("countable"))


@query("t08_refusal", f"with {_ROWS} select accession, not has_report or status = 'UNABLE_TO_INFER' or extraction_mode = 'UNABLE_TO_EXTRACT' as refused from rows_")
def t08(spark, sf):
    return _rows(spark, sf).select("accession", (~F.col("has_report") | X.refused(F.col("status"), F.col("extraction_mode"))).alias("refused"))


@query("j05_fetch_stats", f"with {_ROWS}, s as (select cast(o_orderkey as varchar) as accession, o_custkey as n_runs from orders where o_orderkey % 2 = 0) select r.accession, n_runs from rows_ r left join s on r.accession = s.accession")
def j05(spark, sf):
    s = D.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("accession"), F.col("o_custkey").alias("n_runs"))
    return _rows(spark, sf).select("accession").join(s, "accession", "left")


@query("j09_metadata_assembly", f"with {D.RUNS}, a as (select srr, nullif(sample_title, '') as t from runs where md5(srr) < 'a'), b as (select srr, nullif(library_strategy, '') as t from runs where md5(srr) > '5') select coalesce(a.srr, b.srr) as srr, coalesce(a.t, b.t, '') as label from a full join b on a.srr = b.srr")
def j09(spark, sf):
    r = D.runs(spark, sf)
    a = r.where("md5(srr) < 'a'").select("srr", F.nullif("sample_title", F.lit("")).alias("a"))
    b = r.where("md5(srr) > '5'").select("srr", F.nullif("library_strategy", F.lit("")).alias("b"))
    return a.join(b, "srr", "full").select("srr", F.coalesce("a", "b", F.lit("")).alias("label"))


@query("j11_three_arms", "select a.doc_id, a.quality as a, b.toxic as b, c.lang as c from labels a join (select doc_id, toxic from labels where doc_id % 2 = 0) b on a.doc_id = b.doc_id left join (select doc_id, lang from documents where doc_id % 3 = 0) c on a.doc_id = c.doc_id")
def j11(spark, sf):
    labels = D.table(spark, sf, "labels")
    b = labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("b"))
    c = D.table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("c"))
    return labels.select("doc_id", F.col("quality").alias("a")).join(b, "doc_id").join(c, "doc_id", "left")


@query("j16_sampled_in_truth", f"with {_ROWS} select o_orderkey, r.accession is not null as in_truth from orders left join (select accession from rows_ where has_report) r on cast(o_orderkey as varchar) = r.accession")
def j16(spark, sf):
    known = _rows(spark, sf).where("has_report").select("accession", F.lit(True).alias("hit"))
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("accession"))
    return o.join(known, "accession", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("in_truth"))


@query("j19_round_triples", _TOPK + _JACC + " select n.a as a, n.b as b, f.b as c, n.distance as near, f.distance as far from d f join d n on f.a = n.a and n.b = n.a + 1 and f.b >= f.a + 2")
def j19(spark, sf):
    d = Q.jaccard_distances(Q.kmer_sets(C.unique_counts(D.inserts(spark, sf)), 6))
    near = d.where("b = a + 1").select("a", "b", F.col("distance").alias("near"))
    far = d.where("b >= a + 2").select("a", F.col("b").alias("c"), F.col("distance").alias("far"))
    return near.join(F.broadcast(far), "a").select("a", "b", "c", "near", "far")


@query("j23_expected_files", f"with {D.RUNS}, e as (select srr, unnest([srr || '_1.fastq.gz', srr || '_2.fastq.gz']) as file from runs) select srr, count(*) as n_expected, count(*) filter (not (cast(substr(srr, 4) as bigint) % 3 = 0 and file like '%_2.fastq.gz')) as n_available from e group by srr")
def j23(spark, sf):
    names = F.explode(F.array(F.concat("srr", F.lit("_1.fastq.gz")), F.concat("srr", F.lit("_2.fastq.gz"))))
    expected = D.runs(spark, sf).select("srr", names.alias("file"))
    second = F.col("file").endswith("_2.fastq.gz") & (F.substring("srr", 4, 20).cast("long") % 3 == 0)
    return S.available_files(expected, expected.where(~second))


@query("a47_metric_arms", f"with {_ROWS} select read_state as arm, count(*) as n, count(*) filter (has_report) as n_reports, count(*) filter (status = 'HIGH') as n_high from rows_ group by read_state union all select 'all', count(*), count(*) filter (has_report), count(*) filter (status = 'HIGH') from rows_")
def a47(spark, sf):
    return S.metric_arms(_rows(spark, sf))


@query("a49_corpus_audit", f"with {_ROWS} select count(*) as n_sampled, count(*) filter (has_report) as n_with_report, count(*) filter (has_report and status <> 'UNABLE_TO_INFER') as n_with_qc, count(*) filter (status = 'UNABLE_TO_INFER') / count(*) filter (has_report) as refused_share from rows_")
def a49(spark, sf):
    return S.corpus_audit(_rows(spark, sf))


@query("a50_scorecard", f"with {_ROWS}, o(status, place) as (values ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3), ('UNABLE_TO_INFER', 4), ('NO_REPORT', 5)), c as (select coalesce(status, 'NO_REPORT') as status, count(*) as n from rows_ group by 1) select o.status, place, coalesce(n, 0) as n from o left join c on o.status = c.status")
def a50(spark, sf):
    order = spark.createDataFrame([("HIGH", 1), ("MEDIUM", 2), ("LOW", 3), ("UNABLE_TO_INFER", 4), ("NO_REPORT", 5)], "status string, place int")
    return order.join(S.distribution(_rows(spark, sf), "status"), "status", "left").na.fill(0, ["n"]).select("status", "place", "n")


@query("a61_completeness", _ELIG + " select round(100.0::double * count(*) filter (classification <> 'NON_SELEX_ASSAY') / count(*), 6) as percent_usable from el")
def a61(spark, sf):
    usable = F.count_if(F.col("classification") != "NON_SELEX_ASSAY")
    return M.eligibility(_parsed(spark, sf)).agg(F.round(100.0 * usable / F.count(F.lit(1)), 6).alias("percent_usable"))


@query("e05_adapter_union", f"with {D.RUNS} select srr, 'ena' as origin from runs where md5(srr) < '4' union all select srr, 'sra' from runs where md5(srr) >= 'c'")
def e05(spark, sf):
    r = D.runs(spark, sf).select("srr")
    return r.where("md5(srr) < '4'").withColumn("origin", F.lit("ena")).unionByName(r.where("md5(srr) >= 'c'").withColumn("origin", F.lit("sra")))


@query(
    "m04_discovery",
    f"with {ROUNDS}, k as (select * from parsed where bioproject_id not in ('PRJNA3', 'PRJNA5')) select bioproject_id, count(*) as n_runs, count(*) filter ({_ASSIGNED}) as n_assigned, max(case when trim(library_strategy) = '' then 'not_assessed_v0.1' else library_strategy end) as library_type from k group by bioproject_id",
)
def m04(spark, sf):
    runs = D.runs(spark, sf)
    every = M.first_row(runs.unionByName(runs.where("md5(srr) < '3'")), "srr", ["srr"])
    kept = every.join(F.broadcast(spark.createDataFrame([("PRJNA3",), ("PRJNA5",)], "bioproject_id string")), "bioproject_id", "left_anti")
    x = M.parse_rounds(kept.withColumn("library_type", M.sentinel(F.col("library_strategy"))))
    return x.groupBy("bioproject_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(~M.is_unassigned()).alias("n_assigned"), F.max("library_type").alias("library_type"))


@query("q08_needs_merging", f"with {_ROWS} select accession, coalesce(required_action = 'READ_MERGING_RECOMMENDED', false) as flag from rows_")
def q08(spark, sf):
    return _rows(spark, sf).select("accession", F.coalesce(F.col("required_action") == "READ_MERGING_RECOMMENDED", F.lit(False)).alias("flag"))


@query("s14_widest_enrichment", "with f as (select url as path, page_id % 7 as a, page_id % 5 as b, length(html) as size from pages) select arg_max(path, abs(b - a) * 10000000 + size) as path from f")
def s14(spark, sf):
    from ..sources.tables import widest_enrichment

    p = F.col("page_id")
    files = D.table(spark, sf, "pages").select(F.col("url").alias("path"), (p % 7).alias("from_round"), (p % 5).alias("to_round"), F.length("html").alias("size"))
    return widest_enrichment(files)


@query("s21_trim_totals", f"with {D.READS} select round, count(*) as n_in, count(*) filter (length(seq) > 76) as n_out from reads group by round")
def s21(spark, sf):
    from ..sources.tables import trim_totals

    r = D.reads(spark, sf)
    path = F.concat(F.lit("out/round_0"), F.col("round").cast("string"), F.lit("/a.fasta"))
    return trim_totals(r.select(F.array(path).alias("output_paths"), F.lit(1).cast("long").alias("n_in"), (F.length("seq") > 76).cast("long").alias("n_out")))


@query("w15_sorted_output", f"with {D.RUNS} select bioproject_id, srr, row_number() over (order by bioproject_id, srr) as place from runs where bioproject_id = 'PRJNA7'")
def w15(spark, sf):
    one = D.runs(spark, sf).where("bioproject_id = 'PRJNA7'").select("bioproject_id", "srr")
    return one.withColumn("place", F.row_number().over(Window.orderBy("bioproject_id", "srr")).cast("long"))


_ANNOTATED = "select o_orderkey, concat(o_orderpriority, ' (', o_orderstatus, ')  ', cast(o_orderkey % 50 as varchar), ' nt') as cell from orders"


@query("f25_annotation_normalise", f"with x as ({_ANNOTATED}) select o_orderkey, trim(regexp_replace(regexp_replace(lower(cell), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) as label, cast(regexp_extract(cell, '([0-9]+)', 1) as integer) as first_number from x")
def f25(spark, sf):
    cell = F.concat("o_orderpriority", F.lit(" ("), "o_orderstatus", F.lit(")  "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" nt"))
    return D.table(spark, sf, "orders").select("o_orderkey", M.normalised_annotation(cell).alias("label"), M.first_integer(cell).alias("first_number"))


@query("a48_fetch_statistics", f"with {D.RUNS}, x as (select bioproject_id, case when length(sample_title) = 0 then 'no_url' when cast(substr(srr, 4) as bigint) % 5 = 0 then 'missing' else 'available' end as state from runs) select bioproject_id, count(*) as n_expected, count(*) filter (state = 'available') as n_available, count(*) filter (state = 'missing') as n_missing, count(*) filter (state = 'no_url') as n_no_url from x group by bioproject_id")
def a48(spark, sf):
    state = F.when(F.length("sample_title") == 0, "no_url").when(F.substring("srr", 4, 20).cast("long") % 5 == 0, "missing").otherwise("available")
    marked = D.runs(spark, sf).select("bioproject_id", state.alias("state"))
    return marked.groupBy("bioproject_id").agg(F.count(F.lit(1)).alias("n_expected"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("available", "missing", "no_url")])


@query("q11_consistency_batch", _TOPK + _JACC + " select 'even' as dataset, count(*) as n_pairs, round(avg(distance), 9) as mean_distance from d where a % 2 = 0 and b % 2 = 0 union all select 'odd', count(*), round(avg(distance), 9) from d where a % 2 = 1 and b % 2 = 1")
def q11(spark, sf):
    d = Q.jaccard_distances(Q.kmer_sets(C.unique_counts(D.inserts(spark, sf)), 6))
    same = d.where("a % 2 = b % 2").withColumn("dataset", F.when(F.col("a") % 2 == 0, "even").otherwise("odd"))
    return same.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("distance"), 9).alias("mean_distance"))
