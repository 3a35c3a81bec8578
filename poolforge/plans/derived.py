"""Sequencing pools and run metadata derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIVE = "GGTAATACGACTCACTATAGGG"
THREE = "CCATGCATGCATGCATGCAT"
THREE_VARIANT = "CCATGCATGGATGCATGCAT"
INSERT = 30
_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"

READS = f"""reads as (
select cast(l_linenumber as integer) as round, l_orderkey*10 + l_linenumber as rec,
  concat(substr(translate(md5(concat('t5_', cast(l_linenumber as varchar(9)))), '{_HEX}', '{_BASES}'), 1, cast(4 + l_linenumber % 4 as integer)),
    '{FIVE}',
    translate(substr(md5(cast(l_partkey % cast(floor(2000/l_linenumber) as bigint) as varchar(20))),1,{INSERT}), '{_HEX}', '{_BASES}'),
    case when l_suppkey % 20 = 0 then '{THREE_VARIANT}' else '{THREE}' end) as seq
from lineitem)"""
COUNTS = READS + """, counts as (select round, seq, count(*) as reads from reads group by round, seq)"""
#: Inserts alone: what trimming leaves of the reads.
INSERTS = READS + f""", inserts as (select round, substr(seq, length(seq) - {len(THREE) + INSERT - 1}, {INSERT}) as seq from reads),
icounts as (select round, seq, count(*) as reads from inserts group by round, seq)"""
RUNS = """runs as (
select concat('SRR', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as srr,
  concat('PRJNA', cast(o_custkey % 97 as varchar(9))) as bioproject_id,
  case o_orderkey % 8
    when 0 then concat('Round ', cast(o_custkey % 9 as varchar(9)))
    when 1 then concat('TNF_R', cast(o_custkey % 9 as varchar(9)))
    when 2 then concat('Selex_', cast(o_custkey % 9 as varchar(9)), '_cyc')
    when 3 then 'R1 pool 2'       when 4 then 'naive library'
    when 5 then concat('DNAFOXR0', cast(o_custkey % 9 as varchar(9)))
    when 6 then '' else concat('lib-', cast(o_custkey % 9 as varchar(9)), 'R') end as sample_title,
  case substr(o_orderpriority,1,1) when '1' then 'SELEX' when '2' then 'AMPLICON'
    when '3' then 'RNA-Seq' when '4' then '' else 'OTHER' end as library_strategy,
  concat('SAMN', cast(o_custkey as varchar(20))) as sample_accession
from orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the cluster's shared one, or a temporary one where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(shared or tempfile.mkdtemp(prefix='shared_')).removeprefix('file://').rstrip('/')}/{tag}_{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, rec, seq: seven rounds whose pool narrows, with a tag of its own before each round's flank."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    cores = spark.sparkContext.defaultParallelism
    if len(lines.inputFiles()) < cores and lines.rdd.getNumPartitions() < cores:
        lines = lines.repartition(cores)  # a small file is one split, and would be one task
    tag = F.substring(F.translate(F.md5(F.concat(F.lit("t5_"), n.cast("string"))), _HEX, _BASES), F.lit(1), (4 + n % 4).cast("int"))
    key = F.col("l_partkey") % F.floor(2000 / n)
    insert = F.translate(F.substring(F.md5(key.cast("string")), 1, INSERT), _HEX, _BASES)
    three = F.when(F.col("l_suppkey") % 20 == 0, THREE_VARIANT).otherwise(THREE)
    return lines.select(n.cast("int").alias("round"), (F.col("l_orderkey") * 10 + n).alias("rec"), F.concat(tag, F.lit(FIVE), insert, three).alias("seq"))


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round, seq: the random region of each read."""
    r = reads(spark, sf_dir)
    return r.select("round", F.substring("seq", F.length("seq") - (len(THREE) + INSERT - 1), F.lit(INSERT)).alias("seq"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive-style run metadata with eight shapes of titles."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 9).cast("string")
    shapes = [F.concat(F.lit("Round "), c), F.concat(F.lit("TNF_R"), c), F.concat(F.lit("Selex_"), c, F.lit("_cyc")), F.lit("R1 pool 2"), F.lit("naive library"), F.concat(F.lit("DNAFOXR0"), c), F.lit("")]
    title = F.concat(F.lit("lib-"), c, F.lit("R"))
    for i, shape in reversed(list(enumerate(shapes))):
        title = F.when(k % 8 == i, shape).otherwise(title)
    code = F.substring("o_orderpriority", 1, 1)
    strategy = F.when(code == "1", "SELEX").when(code == "2", "AMPLICON").when(code == "3", "RNA-Seq").when(code == "4", "").otherwise("OTHER")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("SRR"), F.lpad(k.cast("string"), 8, "0")).alias("srr"),
        F.concat(F.lit("PRJNA"), (F.col("o_custkey") % 97).cast("string")).alias("bioproject_id"),
        title.alias("sample_title"),
        strategy.alias("library_strategy"),
        F.concat(F.lit("SAMN"), F.col("o_custkey").cast("string")).alias("sample_accession"),
    )
