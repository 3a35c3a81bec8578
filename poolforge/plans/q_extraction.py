"""Queries on extraction by report, merging of inputs, trees of rounds and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from ..operators import batch as B
from ..operators import counts as C
from ..operators import extraction as X
from ..operators import inference as I
from ..registry import query
from ..sources import trees
from . import derived as D

_REPORT = {"primer_5p": D.FIVE, "primer_3p": D.THREE, "extraction_mode": "BOTH_PRIMERS_SINGLE_READ", "status": "HIGH", "orientation": "REVERSE"}


def _turned(spark, sf):
    return D.reads(spark, sf).withColumn("seq", reverse_complement(F.col("seq")))


@query("t18_extraction", f"with {D.READS} select round, rec, substr(seq, length(seq) - 49, 30) as seq from reads")
def t18(spark, sf):
    return X.run_extract(_turned(spark, sf), _REPORT).reads.select("round", "rec", "seq")


@query("t18_override_yields", f"with {D.READS} select round, count(*) as n_in, count(*) as n_out, 1.0::double as share from reads group by round")
def t18y(spark, sf):
    return X.run_extract(D.reads(spark, sf), {"status": "UNABLE_TO_INFER"}, five=D.FIVE).yields


@query("t06_merged_inputs", f"with {D.READS}, p as (select round, case when rec % 3 = 0 then 'a' when rec % 3 = 1 then 'b' else 'c' end as file, rec, seq from reads), z as (select round, file, max(rec) + 1 as size from p group by all), o as (select round, file, coalesce(sum(size) over (partition by round order by file rows between unbounded preceding and 1 preceding), 0) as b from z) select p.round, p.file, cast(p.rec + o.b as bigint) as rec, seq from p join o on p.round = o.round and p.file = o.file")
def t06(spark, sf):
    file = F.when(F.col("rec") % 3 == 0, "a").when(F.col("rec") % 3 == 1, "b").otherwise("c")
    return X.merged_inputs(D.reads(spark, sf).select("round", file.alias("file"), "rec", "seq"))


_TARGET = "case when rec % 3 = 0 then 'alpha' when rec % 3 = 1 then 'beta' else 'unassigned' end"
_PLACED = f"with {D.READS}, p as (select {_TARGET} as target, 'round_0' || round as label, round, seq from reads where rec % 2 = 0), c as (select target, label, round, seq, count(*) as reads from p where target <> 'unassigned' group by all)"


def _tree(spark, sf):
    """Reads as if of files: a third of them unassigned, half of them second reads."""
    reads = D.reads(spark, sf)
    target = F.when(F.col("rec") % 3 == 0, "alpha").when(F.col("rec") % 3 == 1, "beta").otherwise("unassigned")
    file = F.concat(F.lit("file:///raw/P1/"), target, F.lit("/round_0"), F.col("round").cast("string"), F.lit("/a_"), (1 + F.col("rec") % 2).cast("string"), F.lit(".fastq.gz"))
    return trees.placed(reads.select(file.alias("file"), "rec", "seq"), "/raw/P1")


@query("t14_tree_counts", _PLACED + " select target, label, round, seq, reads from c")
def t14(spark, sf):
    return X.tree_counts(_tree(spark, sf))


@query("t14_tree_stats", _PLACED + " select target, label, round, cast(sum(reads) as bigint) as n_reads, count(*) as n_unique, max(reads) as top_reads, max(reads) / sum(reads) as top1_share, count(*) filter (reads = 1) as n_singletons from c group by all")
def t14s(spark, sf):
    return X.tree_stats(X.tree_counts(_tree(spark, sf)))


@query("x04_flanks_of_counts", f"with {D.COUNTS} select 1 as round, 'ATTGT{D.FIVE}' as five, '{D.THREE}' as three, cast(round_even(avg(length(seq)), 0) as integer) as mean_length, cast(round_even(avg(length(seq)), 0) as integer) - {len(D.FIVE) + 5 + len(D.THREE)} as random_length from counts where round = 1")
def x04(spark, sf):
    found = I.detect_from_counts(C.unique_counts(D.reads(spark, sf)).where("round = 1"))
    rows = [(k, f["five"].sequence, f["three"].sequence, f["mean_length"], f["random_length"]) for k, f in found.items()]
    return spark.createDataFrame(rows, "round int, five string, three string, mean_length int, random_length int")


_NUMBER = "cast(substr(bioproject_id, 6) as integer) % 11"


@query("b01_batch_statuses", f"with {D.RUNS}, n as (select distinct bioproject_id as accession, {_NUMBER} as k from runs) select accession, case k when 0 then 'FETCH_REFUSED' when 1 then 'FETCH_FAILED' when 2 then 'DETECT_FAILED' when 3 then 'EXTRACT_REFUSED' when 4 then 'EXTRACT_FAILED' when 5 then 'SKIPPED_READ_MERGING_RECOMMENDED' when 6 then 'COUNT_FAILED' when 7 then 'QC_FAILED' when 8 then 'UNEXPECTED_FAILURE' else 'OK' end as status, case when k in (0, 1) then null when k = 2 then 'fetch' when k in (3, 4) then 'detect' when k in (5, 6) then 'extract' when k = 7 then 'count' when k = 8 then null else 'qc' end as last_stage_completed from n")
def b01(spark, sf):
    outcomes = {0: ("fetch", B.Refused), 1: ("fetch", ValueError), 2: ("detect", ValueError), 3: ("extract", B.Refused), 4: ("extract", ValueError), 6: ("count", ValueError), 7: ("qc", ValueError)}
    number = lambda name: int(name[5:]) % 11

    def step(stage):
        def run(name, fields):
            at, error = outcomes.get(number(name), (None, None))
            if at == stage:
                raise error(name)
            return {"required_action": "READ_MERGING_RECOMMENDED" if number(name) == 5 else "NONE"}

        return run

    def finished(name, stage):
        if number(name) == 8:
            raise OSError(name)
        return {} if number(name) == 9 and stage == "fetch" else None

    names = sorted(r.bioproject_id for r in D.runs(spark, sf).select("bioproject_id").distinct().collect())
    rows = B.run_accessions(names, {s: step(s) for s in B.STAGES}, finished)
    return spark.createDataFrame([(r["accession"], r["status"], r["last_stage_completed"]) for r in rows], "accession string, status string, last_stage_completed string")
