"""Folders of rounds: root/round_NN/files for one target, root/target/round_NN/files for several."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fastq import read_fastq_text

# Folders beside targets that are none.
RESERVED = ("unassigned", "processed_external")


def placed(rows: DataFrame, root: str) -> DataFrame:
    """rows (file: a path) that lie in a round of root, with target (null for one), label (the folder) and round.

    round is the number that ends the label, or null. Files of second reads and of reserved folders are left out, as are files
    that lie elsewhere.
    """
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    pattern = rf"\Q{base}\E/(?:([^/]+)/)?(round_[^/]+)/[^/]+$"
    part = lambda i: F.nullif(F.regexp_extract("file", pattern, i), F.lit(""))
    out = rows.withColumns({"target": part(1), "label": part(2)})
    out = out.where(F.col("label").isNotNull() & ~F.coalesce(F.col("target").isin(*RESERVED) | F.col("target").startswith("round_"), F.lit(False)))
    out = out.where(~F.col("file").rlike(r"_2\.f(?:ast)?q(?:\.gz)?$"))
    return out.withColumn("round", F.regexp_extract("label", r"_([0-9]+)$", 1).try_cast("int"))


def check_layout(files: DataFrame) -> None:
    """Raise if some of the placed files lie in targets and some in none."""
    one = files.agg(F.count("target").alias("in_target"), F.count(F.lit(1)).alias("n")).first()
    if 0 < one.in_target < one.n:
        raise ValueError("rounds lie both at the top and in targets")


def read_round_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, rec, seq, target, label and round of all first reads under root; a mixed layout is an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.f*q*").load(root)
    check_layout(placed(listed.select(F.col("path").alias("file")), root))
    return placed(read_fastq_text(spark, root, recursive=True), root)


def valid_fastq_files(spark: SparkSession, root: str, smallest: int = 1024) -> DataFrame:
    """file, size and large_enough of the FASTQ files under root, from the listing alone; reading with failfast tests the content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.f*q*").load(root)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"), (F.col("length") >= smallest).alias("large_enough"))
