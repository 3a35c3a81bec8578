"""Queries that write the derived pool or metadata as files and read them again by the engine's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import scoring as S
from ..registry import query
from ..sources import fastq as Q
from ..sources import tables as T
from . import derived as D
from .q_scoring import _ROWS, _rows

_REC = "cast(name as bigint) as rec"


def _records(spark, sf, some_empty: bool = False):
    """The pool's reads as records named by their number; with some_empty a tenth has no sequence."""
    reads = D.reads(spark, sf).withColumn("name", F.col("rec").cast("string"))
    seq = F.when(F.col("rec") % 10 == 0, "").otherwise(F.col("seq")) if some_empty else F.col("seq")
    return reads.select("round", "rec", "name", seq.alias("seq"), F.reverse(seq).alias("qual"))


@query("s01_fastq_scan", f"with {D.READS} select rec, seq from reads")
def s01(spark, sf):
    path = D.scratch(spark, "s01") + "/reads"
    Q.write_fastq(_records(spark, sf), path)
    return Q.read_fastq(spark, path + "/part-*").selectExpr(_REC, "seq")


@query("s02_fastq_without_empty", f"with {D.READS} select rec, seq from reads where rec % 10 <> 0")
def s02(spark, sf):
    path = D.scratch(spark, "s02") + "/reads"
    Q.write_fastq(_records(spark, sf, some_empty=True), path, "none")
    return Q.read_fastq(spark, path + "/part-*", skip_empty=True).selectExpr(_REC, "seq")


@query("s03_fastq_strict", f"with {D.READS} select rec, seq, reverse(seq) as qual from reads")
def s03(spark, sf):
    path = D.scratch(spark, "s03") + "/reads"
    Q.write_fastq(_records(spark, sf), path)
    return Q.read_fastq(spark, path + "/part-*", mode="failfast").selectExpr(_REC, "seq", "qual")


@query("s04_fastq_lenient", f"with {D.READS} select rec, seq, reverse(seq) as qual from reads")
def s04(spark, sf):
    path = D.scratch(spark, "s04") + "/reads"
    rows = _records(spark, sf)
    whole = rows.select("round", F.lit(0).alias("last"), F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
    cut = rows.select("round").distinct().select("round", F.lit(1).alias("last"), F.lit("@cut\nACGT").alias("value"))
    # Each round's file ends with a record that is cut off.
    whole.unionByName(cut).repartition("round").sortWithinPartitions("round", "last").select("round", "value").write.partitionBy("round").text(path)
    return Q.read_fastq(spark, path + "/round=*/part-*", mode="droptail").selectExpr(_REC, "seq", "qual")


@query("s06_fasta_scan", f"with {D.READS} select rec, seq from reads where rec % 10 <> 0")
def s06(spark, sf):
    path = D.scratch(spark, "s06") + "/reads"
    Q.write_fasta(_records(spark, sf, some_empty=True), path, width=40)
    return Q.read_fasta(spark, path + "/part-*").selectExpr(_REC, "seq")


@query("s07_either_scan", f"with {D.READS}, e as (select case when rec % 10 = 0 then '' else seq end as seq from reads) select seq, count(*) as reads from e group by seq")
def s07(spark, sf):
    path, rows = D.scratch(spark, "s07"), _records(spark, sf, some_empty=True)
    Q.write_fastq(rows.where("rec % 20 < 10"), path + "/a")
    Q.write_fasta(rows.where("rec % 20 >= 10"), path + "/b", width=40, compression="gzip")
    return Q.read_sequences(spark, path + "/*/part-*").groupBy("seq").agg(F.count(F.lit(1)).alias("reads"))


_FILES = f"{D.RUNS}, k as (select srr, cast(substr(srr, 4) as bigint) as k from runs), files as (select srr || '_1.fastq.gz' as file from k union all select srr || '_2.fastq.gz' from k where k % 3 <> 0 union all select srr || '.fastq.gz' from k where k % 5 = 0)"


def _files(spark, sf):
    k = F.substring("srr", 4, 20).cast("long")
    names = F.array(F.lit("_1"), F.when(k % 3 != 0, "_2"), F.when(k % 5 == 0, ""))
    return D.runs(spark, sf).select("srr", F.explode(names).alias("end")).where("end is not null").select(F.concat("srr", "end", F.lit(".fastq.gz")).alias("file"))


@query("s09_first_reads", f"with {_FILES} select a.file, b.file as mate_file from files a left join files b on a.file like '%\\_1.fastq.gz' escape '\\' and b.file = substr(a.file, 1, length(a.file) - 11) || '_2.fastq.gz' where a.file not like '%\\_2.fastq.gz' escape '\\'")
def s09(spark, sf):
    return Q.first_reads(_files(spark, sf))


@query("s10_files_of_runs", f"with {_FILES} select k.srr, files.file from k join files on files.file in (k.srr || '_1.fastq.gz', k.srr || '_2.fastq.gz', k.srr || '.fastq.gz') where k.k % 2 = 0")
def s10(spark, sf):
    runs = D.runs(spark, sf).where(F.substring("srr", 4, 20).cast("long") % 2 == 0)
    longer = D.runs(spark, sf).select(F.concat("srr", F.lit("0_1.fastq.gz")).alias("file"))
    return Q.files_of_runs(_files(spark, sf).unionByName(longer), runs)


@query("s11_counts_scan", f"with {D.COUNTS} select round, seq, reads from counts")
def s11(spark, sf):
    path = D.scratch(spark, "s11") + "/counts"
    T.write_counts(C.unique_counts(D.reads(spark, sf)), path)
    return T.read_counts(spark, path)


@query("s12_counts_by_alias", f"with {D.COUNTS} select round, seq, reads from counts")
def s12(spark, sf):
    path = D.scratch(spark, "s12") + "/counts"
    C.unique_counts(D.reads(spark, sf)).select("round", F.col("seq").alias("aptamer"), F.col("reads").cast("int").alias("abundance"), F.lit(1.0).alias("rpm")).write.parquet(path)
    return T.read_counts(spark, path)


@query("s13_round_folders", f"with {D.COUNTS} select round, seq, reads from counts")
def s13(spark, sf):
    path, counts = D.scratch(spark, "s13"), C.unique_counts(D.reads(spark, sf)).cache()
    for r in counts.select("round").distinct().orderBy("round").collect():
        counts.where(F.col("round") == r["round"]).select(F.col("seq").alias("sequence"), "reads").write.parquet(f"{path}/round_{r['round']:02d}/counts.parquet")
    counts.unpersist()
    return T.read_counts(spark, path + "/round_*/counts.parquet")


@query("s15_round_map", f"with {D.READS} select distinct 'a_' || round || '.fastq' as file, round from reads")
def s15(spark, sf):
    path = D.scratch(spark, "s15") + "/map.tsv"
    rounds = D.reads(spark, sf).select("round").distinct()
    T.write_tsv(rounds.select(F.concat(F.lit("raw/a_"), "round", F.lit(".fastq")).alias("file"), F.col("round").alias("round_number")), path)
    return T.read_round_map(spark, path)


@query("s16_accessions", f"with {D.RUNS} select distinct bioproject_id as accession from runs")
def s16(spark, sf):
    path = D.scratch(spark, "s16") + "/accessions.tsv"
    names = D.runs(spark, sf).select(F.col("bioproject_id").alias("accession")).distinct()
    T.write_tsv(names.unionByName(spark.createDataFrame([(" ",)], "accession string")), path)
    return spark.createDataFrame([(a,) for a in T.read_accessions(spark, path)], "accession string")


@query("s17_sample_sheet", "select cast(n_regionkey as varchar) as srr, upper(n_name) as barcode, cast(n_nationkey + case when n_nationkey < 5 then 100 else 0 end as integer) as round from nation")
def s17(spark, sf):
    path = D.scratch(spark, "s17") + "/sheet.tsv"
    rows = D.table(spark, sf, "nation").select(F.col("n_regionkey").alias("accession"), F.lower("n_name").alias("barcode"), F.col("n_nationkey").cast("int").alias("round"))
    T.write_tsv(rows.unionByName(rows.where("round < 5").withColumn("round", F.col("round") + 100)), path, order=["round"])
    return T.read_sample_sheet(spark, path)


_TEXT = f"with {D.RUNS} select srr, bioproject_id, sample_title, library_strategy, sample_accession from runs"


@query("s18_table_or_empty", _TEXT)
def s18(spark, sf):
    path, rows = D.scratch(spark, "s18"), D.runs(spark, sf)
    rows.write.option("header", True).csv(path + "/runs")
    return T.read_or_empty(spark, path + "/runs", rows.columns).unionByName(T.read_or_empty(spark, path + "/none", rows.columns))


@query("s33_catalogue", _TEXT)
def s33(spark, sf):
    path = D.scratch(spark, "s33") + "/catalogue"
    D.runs(spark, sf).write.option("header", True).csv(path)
    return T.read_tsv(spark, path, sep=",")


@query("s34_curated_records", "select n_name as accession, case when n_nationkey % 2 = 0 then 'concordant' else 'not_stated' end as status, case when n_nationkey % 2 = 0 then r_name end as value from nation join region on n_regionkey = r_regionkey")
def s34(spark, sf):
    path = D.scratch(spark, "s34") + "/records"
    known = F.col("n_nationkey") % 2 == 0
    cell = F.struct(F.when(known, "concordant").otherwise("not_stated").alias("status"), F.when(known, F.col("r_name")).alias("value"))
    rows = D.table(spark, sf, "nation").join(F.broadcast(D.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct(F.col("n_name").alias("accession"), F.struct(cell.alias("target")).alias("fields"))
    # A file of records is one array: the nations' few rows.
    rows.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)
    return T.read_records(spark, path).select("accession", "fields.target.status", "fields.target.value")


@query("s26_file_digests", "select cast(r_regionkey as integer) as region, sha256('{\"r_name\":\"' || r_name || '\"}' || chr(10)) as sha256 from region")
def s26(spark, sf):
    path = D.scratch(spark, "s26") + "/files"
    D.table(spark, sf, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").json(path)
    return T.file_digests(spark, path).select(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("int").alias("region"), "sha256")


@query("s55_round_map_of_inputs", f"with {D.READS} select distinct 'a_' || round || '.fastq' as file, round from reads where round <> 3")
def s55(spark, sf):
    folder = F.when(F.col("round") == 3, "round_unknown").otherwise(F.concat(F.lit("round_0"), "round"))
    return T.round_map_of(D.reads(spark, sf).select("round").distinct().select(F.concat(F.lit("raw/"), folder, F.lit("/a_"), "round", F.lit(".fastq")).alias("file")))


@query("p13_verified", f"with {_ROWS} select accession, has_report as verified from rows_")
def p13(spark, sf):
    kept, skipped = S.verified(_rows(spark, sf).select("accession", F.when(F.col("has_report"), True).alias("verified")))
    return kept.select("accession", "verified").unionByName(skipped.withColumn("verified", F.lit(False)))


@query("j10_in_one_arm", "select cast(o_orderkey as varchar) as accession, case when o_orderkey % 2 = 0 then 'one' else 'two' end as arm from orders where (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)")
def j10(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("accession"))
    return S.in_one_arm(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"))


@query("a04_cached_stats", f"with {D.COUNTS} select round, cast(sum(reads) as bigint) as n_reads, count(*) as n_unique, max(reads) as top_reads, count(*) filter (reads = 1) as n_singletons, count(*) filter (reads >= 10) as n_ge_10, count(*) filter (reads >= 100) as n_ge_100, max(reads) * 1e6::double / sum(reads) as top_rpm, max(reads) / sum(reads) as top1_share, count(*) filter (reads = 1) / count(*) as singleton_share, true as no_entropy, cast(null as boolean) as trimmed from counts group by round")
def a04(spark, sf):
    path = D.scratch(spark, "a04") + "/counts"
    T.write_counts(C.unique_counts(D.reads(spark, sf)), path)
    return C.cached_stats(T.read_counts(spark, path)).withColumn("no_entropy", F.isnan("shannon_bits")).drop("shannon_bits")
