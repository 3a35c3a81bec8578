"""Queries that write the small files of a study and read them again."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import metadata as M
from ..operators import signals as G
from ..registry import query
from ..sources import releases
from ..sources import reports as R
from ..sources import tables as T
from . import derived as D
from .q_inference import _MIXED, _STRANDS, _mixed
from .q_metadata import _ASSIGNED, ROUNDS, _parsed
from .q_scoring import _ROWS, _rows


def _seed(spark, sf):
    """A seed file with an entry for each nation, rounds by hand for some."""
    path = D.scratch(spark, "seed") + "/seed.yaml"
    entries = []
    for r in D.table(spark, sf, "nation").select("n_nationkey", "n_name").collect():
        k = r.n_nationkey
        entry = {"bioproject_id": f"PRJNA{k}", "protein_target": r.n_name, "paper_pmid": int(k), "library_type": "RNA_confirmed" if k % 2 else "ambiguous"}
        entries.append(entry | ({"manual_round_mapping": {f"SRR{k}": int(k) % 9}} if k % 3 == 0 else {}))
    with open(path, "w") as f:
        json.dump({"entries": entries, "blacklist": [{"bioproject_id": "PRJNA3"}], "small_molecule_targets": ["GTP"]}, f)
    return R.read_seed(spark, path)


@query("s19_seed_rounds", "select 'PRJNA' || n_nationkey as bioproject_id, 'SRR' || n_nationkey as srr, cast(n_nationkey % 9 as integer) as round from nation where n_nationkey % 3 = 0")
def s19(spark, sf):
    return _seed(spark, sf).overrides


@query("s40_seed_studies", "select 'PRJNA' || n_nationkey as bioproject_id, 'seed' as source, n_name as protein_target, '' as paper_doi, cast(n_nationkey as varchar) as paper_pmid, '' as n_rounds_declared, case when n_nationkey % 2 = 1 then 'RNA_confirmed' else 'ambiguous' end as library_type_verification, case when n_nationkey % 2 = 1 then 'y' else 'n' end as include from nation")
def s40(spark, sf):
    return _seed(spark, sf).search()


@query("s54_counted_flags", "select count(*) as n from nation")
def s54(spark, sf):
    path = D.scratch(spark, "s54") + "/flags.yaml"
    evidence = F.to_json(F.struct((F.col("n_nationkey") / 7).alias("share"), F.col("n_regionkey").alias("region")))
    R.write_flags(D.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("warning").alias("severity"), evidence.alias("evidence")), path)
    return spark.createDataFrame([(R.count_flags(spark, path),)], "n long")


@query("s20_strand_report", f"with {_MIXED}{_STRANDS} select round, cast(forward as bigint) as forward, cast(reverse as bigint) as reverse, cast(ambiguous as bigint) as ambiguous from strands")
def s20(spark, sf):
    path = D.scratch(spark, "s20") + "/strands.tsv"
    R.write_strand_report(G.strands(_mixed(spark, sf), D.FIVE, D.THREE), path)
    with open(path, "a") as f:
        f.write("8\t1\t2\n9\tx\t1\t1\n10\t0\t0\t0\n")
    return R.read_strand_report(spark, path)


def _named(spark, sf):
    ends = [F.concat("srr", F.lit(f"_{i}.fastq.gz")) for i in (1, 2)]
    return _parsed(spark, sf).withColumns({"fastq_names": F.array(*ends), "parser_notes": F.col("confidence"), "library_name": F.lit("")})


_NAMED = f"with {ROUNDS}, f as (select *, unnest([srr || '_1.fastq.gz', srr || '_2.fastq.gz']) as file from parsed)"


@query("s28_round_list", _NAMED + f" select file, round_number as round from f where {_ASSIGNED}")
def s28(spark, sf):
    path = D.scratch(spark, "s28") + "/rounds.tsv"
    T.write_tsv(R.round_list(_named(spark, sf)), path, order=["file"])
    return T.read_round_map(spark, path)


@query("s28_manual_review", _NAMED + f" select file, srr, confidence as parser_notes, sample_title, '' as library_name from f where not {_ASSIGNED}")
def s28m(spark, sf):
    path = D.scratch(spark, "s28m") + "/review.tsv"
    T.write_tsv(R.manual_review(_named(spark, sf)), path, order=["srr", "file"])
    return T.read_tsv(spark, path)


@query("s29_run_summary", f"with {_ROWS} select accession, coalesce(status, '') as status, 'qc' as last_stage_completed, coalesce(status, '') as library_report_status, coalesce(extraction_mode, '') as extraction_mode, coalesce(required_action, '') as required_action, case when has_report then printf('%.4f', (cast(accession as bigint) % 7) / 7) else '' end as confidence, cast(cast(accession as bigint) % 3 as varchar) as flags_raised, 'a b c' as notes from rows_")
def s29(spark, sf):
    path, k = D.scratch(spark, "s29") + "/summary.tsv", F.col("accession").cast("long")
    rows = _rows(spark, sf).select("accession", "status", F.lit("qc").alias("last_stage_completed"), F.col("status").alias("library_report_status"), "extraction_mode", "required_action", F.when(F.col("has_report"), k % 7 / 7).alias("confidence"), (k % 3).alias("flags_raised"), F.lit("a\tb\nc").alias("notes"))
    T.write_tsv(R.run_summary(rows), path)
    return T.read_tsv(spark, path)


@query("s31_fixed_columns", f"with {D.RUNS} select srr, '' as library_name, sample_title from runs")
def s31(spark, sf):
    path, names = D.scratch(spark, "s31") + "/samples", ["srr", "library_name", "sample_title"]
    R.write_columns(D.runs(spark, sf), path, names)
    return T.read_tsv(spark, path, sep=",")


@query("s51_ground_truth", "select cast(o_orderkey as varchar) as accession, cast(case when o_orderkey % 4 = 0 then 0 else o_orderkey % 50 end as integer) as n_length_truth, o_orderkey % 3 = 0 as verified, o_orderkey % 5 <> 0 as score_3p, 'auto' as round_map_source, '' as notes, false as mono_round from orders")
def s51(spark, sf):
    path, k = D.scratch(spark, "s51") + "/truth", F.col("o_orderkey")
    length = F.when(k % 4 == 0, "").otherwise((k % 50).cast("string"))
    rows = D.table(spark, sf, "orders").select(k.cast("string").alias("accession"), length.alias("n_length_truth"), F.when(k % 3 == 0, "TRUE").otherwise("1").alias("verified"), F.when(k % 5 == 0, "False").otherwise("").alias("score_3p"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return R.read_truth(spark, path).select("accession", "n_length_truth", "verified", "score_3p", "round_map_source", "notes", "mono_round")


_DIGITS = "select chr(123) || chr(10) || '  \"primer_5p\": \"" + D.FIVE + "\",' || chr(10) || '  \"n_length_distribution\": ' || chr(123) || chr(10) || string_agg('    \"' || k || '\": ' || n, ',' || chr(10) order by k) || chr(10) || '  ' || chr(125) || chr(10) || chr(125) || chr(10) as t from (select n_nationkey * 3 as k, n_regionkey as n from nation)"


@query("s22_library_report", f"with w as ({_DIGITS}) select cast(n_nationkey * 3 as integer) as length, cast(n_regionkey as bigint) as n, sha256(w.t) as sha256 from nation, w")
def s22(spark, sf):
    path = D.scratch(spark, "s22") + "/report.json"
    lengths = {int(r.n_nationkey) * 3: int(r.n_regionkey) for r in D.table(spark, sf, "nation").orderBy(F.desc("n_name")).collect()}
    digest = T.write_json({"primer_5p": D.FIVE, "n_length_distribution": lengths}, path)
    return spark.createDataFrame([(k, v, digest) for k, v in R.read_report(path)["n_length_distribution"].items()], "length int, n long, sha256 string")


@query("s23_manifest", "select 'r_regionkey=' || r_regionkey as folder, sha256('{\"r_name\":\"' || r_name || '\"}' || chr(10)) as sha256, 'UNABLE_TO_EXTRACT' as extraction_mode from region")
def s23(spark, sf):
    path = D.scratch(spark, "s23")
    D.table(spark, sf, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").json(path + "/out")
    D.table(spark, sf, "region").write.parquet(path + "/out/counts")
    R.write_manifest(spark, path + "/manifest.json", {"extraction_mode": "UNABLE_TO_EXTRACT"}, None, path + "/out", accession="PRJNA1")
    row = T.read_json(path + "/manifest.json")
    return spark.createDataFrame([(k.split("/")[0], v, row["extraction_mode"]) for k, v in row["output_sha256"].items()], "folder string, sha256 string, extraction_mode string")


_K = "cast(substr(srr, 4) as bigint)"


@query("m09_sample_rounds", f"""with {ROUNDS}, x as (select *, {_K} as k from parsed) select srr,
case when k in (3, 4) and bioproject_id <> 'PRJNA0' then 9 when k % 6 = 0 then 7 else round_number end as round_number,
case when (k in (3, 4) and bioproject_id <> 'PRJNA0') or k % 6 = 0 then 'HIGH' else confidence end as confidence,
regexp_extract(sample_title, '^([A-Z][A-Za-z0-9_\\-]+)[\\s_\\-]+(?:[Rr]ound|[Rr][0-9]|[Cc]ycle)', 1) as target_hint, cast(case when bioproject_id = 'PRJNA5' then 12 end as integer) as rounds_stated from x""")
def m09(spark, sf):
    k = F.substring("srr", 4, 20).cast("long")
    cell = F.when(k % 6 == 0, '{"round": "7"}').when(k % 6 == 1, "{bad").otherwise("")
    runs = D.runs(spark, sf).withColumn("sample_attributes", cell)
    projects = spark.createDataFrame([("PRJNA5", "After 12 rounds of selection we sequenced the pool.")], "bioproject_id string, abstract string")
    ids = runs.where(k.isin(3, 4)).where("bioproject_id <> 'PRJNA0'").select("bioproject_id", "srr", F.lit(9).alias("round"))
    overrides = ids.unionByName(spark.createDataFrame([("PRJNA0", "SRR00000005", 1)], "bioproject_id string, srr string, round int").join(runs.select("srr", F.col("bioproject_id").alias("own")), "srr").where("own <> 'PRJNA0'").drop("own"))
    return M.parse_sample_rounds(runs, projects=projects, overrides=overrides).select("srr", "round_number", "confidence", "target_hint", "rounds_stated")


@query("x07_adapter_drop", f"with {_ROWS}, p as (select accession, cast(accession as bigint) as k, primer_5p, primer_3p from rows_), q as (select accession, case when k % 4 = 0 then null else primer_5p end as primer_5p, case when k % 9 = 0 then null else primer_3p end as primer_3p, not (k % 4 = 0 or k % 9 = 0) as adapter_clean from p) select * from q")
def x07(spark, sf):
    k = F.col("accession").cast("long")
    five, three = F.when(k % 4 == 0, "agatcggaagagcacacg").otherwise(F.col("primer_5p")), F.when(k % 9 == 0, "GCTCTTCCGATCTAA").otherwise(F.col("primer_3p"))
    return I.without_adapters(_rows(spark, sf).select("accession", five.alias("primer_5p"), three.alias("primer_3p")))


@query("x16_unable_report", "select 'UNABLE_TO_EXTRACT' as extraction_mode, 'UNABLE_TO_INFER' as status, 'MANUAL_PRIMERS_REQUIRED' as required_action, 0.0::double as confidence, 'too few reads: ' || count(*) as failure_reason, count(*) as n from region")
def x16(spark, sf):
    n = D.table(spark, sf, "region").count()
    return I.unable_report(spark, f"too few reads: {n}").select("extraction_mode", "status", "required_action", "confidence", "failure_reason", F.lit(n).cast("long").alias("n"))


@query("s53_trim_baseline", f"with {D.READS} select round, count(*) as n_in, count(*) filter (length(seq) > 76) as n_out from reads group by round")
def s53(spark, sf):
    path = D.scratch(spark, "s53") + "/trim_reports.json"
    by = D.reads(spark, sf).groupBy("round", (F.col("rec") % 3).alias("input")).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.length("seq") > 76).alias("n_out"))
    with open(path, "w") as f:
        json.dump([{"argv": ["trim"], "output_paths": [f"out/round_{r['round']:02d}/a.fasta.gz"], "n_in": r.n_in, "n_out": r.n_out, "rc": 0} for r in by.collect()], f)
    return T.trim_totals(T.read_trim_reports(spark, path))


@query("b08_release_comparison", """select r_regionkey || '.json' as file, '.name' as path, 'DIFFERS' as kind, '"' || r_name || '"' as old, '"' || lower(r_name) || '"' as new from region where r_regionkey % 2 = 0
union all select r_regionkey || '.json', '.rounds[0]', 'MISSING', cast(r_regionkey as varchar), null from region where r_regionkey = 1 union all select '4.tsv', '', 'EXTRA', null, sha256('4' || chr(10)) from region where r_regionkey = 4
union all select '1.json', '.rounds', 'EXTRA', null, '[]' from region where r_regionkey = 1""")
def b08(spark, sf):
    path = D.scratch(spark, "b08")
    for tree in ("old", "new"):
        os.makedirs(f"{path}/{tree}")
    for r in D.table(spark, sf, "region").select("r_regionkey", "r_name").collect():
        k = int(r.r_regionkey)
        for tree in ("old", "new"):
            other = tree == "new"
            row = {"name": r.r_name.lower() if other and k % 2 == 0 else r.r_name, "rounds": [] if other and k == 1 else [k], "runtime": {"elapsed": other}, "out": f"{path}/{tree}/x"}
            with open(f"{path}/{tree}/{k}.json", "w") as f:
                json.dump(row, f)
        if k == 4:
            with open(f"{path}/new/4.tsv", "w") as f:
                f.write("4\n")
    return releases.compared(releases.contents(spark, path + "/old"), releases.contents(spark, path + "/new"))


@query("b07_parameters", "select * from (values ('qc', 'LOW_READS', '10000'), ('qc', 'LOW_MATCH', '0.4'), ('extract', 'ERROR_RATE', '0.1'), ('extract', 'MIN_OVERLAP', '3'), ('extract', 'MAX_LENGTH', '200'), ('detect', 'CORE_LEN', '12'), ('detect', 'CORE_SUPPORT', '0.9')) t(stage, name, value)")
def b07(spark, sf):
    # The values that must equal fixed ones.
    return releases.parameters(spark).where(F.col("name").isin("LOW_READS", "LOW_MATCH", "ERROR_RATE", "MIN_OVERLAP", "MAX_LENGTH", "CORE_LEN", "CORE_SUPPORT"))
