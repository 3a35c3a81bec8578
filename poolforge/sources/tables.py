"""Tables beside reads: round maps, sample sheets, accessions, counts, catalogues; and the output files."""

from __future__ import annotations

import gzip
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that count columns go by.
SEQUENCE_NAMES, READS_NAMES = ("sequence", "seq", "aptamer"), ("count", "reads", "n", "abundance")


def read_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as text, absent cells as empty text."""
    return spark.read.option("header", True).option("sep", sep).option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that hold one array or one object each."""
    return spark.read.option("multiLine", True).json(path)


def read_or_empty(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return read_tsv(spark, path, sep)


def read_round_map(spark: SparkSession, path: str) -> DataFrame:
    """file (base name) and round; a name twice is an error."""
    rows = read_tsv(spark, path).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.col("round_number").cast("int").alias("round"))
    twice = rows.groupBy("file").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"round map names {twice[0].file} twice")
    return rows


def with_rounds(reads: DataFrame, round_map: DataFrame) -> DataFrame:
    """reads with the round of their file; a file without round is an error."""
    out = reads.join(F.broadcast(round_map), "file", "left")
    missing = F.raise_error(F.concat(F.lit("no round for "), F.col("file"))).cast("int")
    return out.withColumn("round", F.when(F.col("round").isNull(), missing).otherwise(F.col("round")))


def read_accessions(spark: SparkSession, path: str) -> list[str]:
    rows = [r.accession.strip() for r in read_tsv(spark, path).select("accession").collect() if r.accession.strip()]
    if len(set(rows)) < len(rows):
        raise ValueError("an accession stands twice")
    return rows


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """srr, barcode (upper case) and round; the last row of a barcode wins."""
    rows = read_tsv(spark, path)
    rows = rows.withColumnRenamed("accession", "srr") if "srr" not in rows.columns else rows
    placed = rows.withColumn("__i", F.monotonically_increasing_id()).withColumn("barcode", F.upper("barcode"))
    return placed.groupBy("srr", "barcode").agg(F.max_by(F.col("round").cast("int"), "__i").alias("round"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """round, seq and reads of count files under round_NN folders, by any of their usual column names."""
    rows = spark.read.parquet(path)
    name = lambda options: next(c for c in options if c in rows.columns)
    rnd = F.col("round") if "round" in rows.columns else F.regexp_extract(F.col("_metadata.file_path"), r"round_([0-9]+)", 1).cast("int")
    return rows.select(rnd.alias("round"), F.col(name(SEQUENCE_NAMES)).alias("seq"), F.col(name(READS_NAMES)).cast("long").alias("reads"))


def round_map_of(files: DataFrame) -> DataFrame:
    """file (base name) and round of files (file: a path) that lie under round_NN folders; others are left out."""
    rnd = F.regexp_extract("file", r"round_([0-9]+)/[^/]+$", 1).try_cast("int")
    return files.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), rnd.alias("round")).where("round is not null")


def write_counts(counts: DataFrame, path: str) -> bool:
    """Counts by round as zstd Parquet; nothing is written for no reads."""
    if counts.limit(1).count() == 0:
        return False
    counts.write.mode("overwrite").option("compression", "zstd").partitionBy("round").parquet(path)
    return True


def widest_enrichment(files: DataFrame) -> DataFrame:
    """The file (path, from_round, to_round, size) with the widest span of rounds, the larger on a tie."""
    return files.agg(F.max_by("path", F.struct(F.abs(F.col("to_round") - F.col("from_round")), "size")).alias("path"))


def trim_totals(reports: DataFrame) -> DataFrame:
    """Reads in and out by round, the round taken from the first output's folder."""
    rnd = F.regexp_extract(F.get("output_paths", F.lit(0)), r"round_([0-9]+)", 1).cast("int")
    return reports.groupBy(rnd.alias("round")).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def read_trim_reports(spark: SparkSession, path: str) -> DataFrame | None:
    """output_paths, n_in and n_out of a file of trim reports; None if it is not there or malformed, as a baseline may be."""
    schema = "output_paths array<string>, n_in long, n_out long"
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows.count()
        return rows
    except Exception:  # whatever is wrong with a baseline, there is none
        return None


def hashable(path) -> object:
    """Whether a file's digest belongs into a manifest."""
    return F.lower(path).rlike(r"\.(fasta|fa|fastq|fq|tsv|json|ya?ml)(\.gz)?$")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of the files whose digests belong into a manifest."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.where(hashable(F.col("path"))).select("path", F.sha2("content", 256).alias("sha256"))


def write_json(row: dict, path: str) -> str:
    """One record as JSON with a final line feed, in field order, maps by key (numbers by value); its SHA-256."""
    order = lambda k: (0, int(k), "") if str(k).lstrip("-").isdigit() else (1, 0, str(k))
    fixed = {k: {str(x): v[x] for x in sorted(v, key=order)} if isinstance(v, dict) else v for k, v in row.items()}
    text = json.dumps(fixed, indent=2, ensure_ascii=False) + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()


def read_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def write_fasta_gz(reads: DataFrame, path: str) -> int:
    """Reads in order of file and record as gzip FASTA that is the same for the same reads; rows stream through the driver."""
    n = 0
    with open(path, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) as out:
        for r in reads.orderBy("file", "rec").select("name", "seq").toLocalIterator():
            out.write(f">{r.name}\n{r.seq}\n".encode())
            n += 1
    return n


def write_tsv(rows: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """A small table as one sorted TSV file; tabs and line feeds in cells become spaces."""
    rows = rows.select(*columns) if columns else rows
    rows = rows.orderBy(*(order or rows.columns[:1]))
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in rows.columns]
    with open(path, "w") as f:
        f.write("\t".join(rows.columns) + "\n")
        for r in rows.select(*clean).toLocalIterator():
            f.write("\t".join(r) + "\n")
