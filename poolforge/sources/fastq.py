"""FASTQ and FASTA files as DataFrames, by Python data sources; a gzip file is one task.

Options: path (a file, folder or glob), mode: failfast (a cut-off last record is an error) or droptail.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FASTQ_SCHEMA = "file string, rec bigint, name string, seq string, qual string"
FASTA_SCHEMA = "file string, rec bigint, name string, seq string"


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    return [f for f in found if os.path.isfile(f) and (not os.path.isdir(path) or f.removesuffix(".gz").endswith(endings))]


def _lines(path: str) -> Iterator[str]:
    opened = gzip.open(path, "rt") if path.endswith(".gz") else open(path)
    with opened as f:
        for line in f:
            yield line.rstrip("\r\n")


def fastq_records(path: str, droptail: bool = False) -> Iterator[tuple[str, str, str]]:
    """name, sequence and quality of each record of four lines."""
    lines, n = _lines(path), 0
    while (head := next(lines, None)) is not None:
        body = [next(lines, None) for _ in range(3)]
        if body[2] is None:
            if droptail or not head.strip():
                return
            raise ValueError(f"{path}: record {n} is cut off")
        yield head.removeprefix("@"), body[0].strip(), body[2]
        n += 1


def fasta_records(path: str, keep_empty: bool = False) -> Iterator[tuple[str, str]]:
    """name and sequence, wrapped lines joined."""
    name, parts = None, []
    for line in _lines(path):
        if line.startswith(">"):
            if name is not None and (parts or keep_empty):
                yield name, "".join(parts)
            name, parts = line[1:], []
        elif name is not None and line.strip():
            parts.append(line.strip())
    if name is not None and (parts or keep_empty):
        yield name, "".join(parts)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, endings: tuple[str, ...], records):
        self.paths, self.records = _files(options["path"], endings), records

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in self.paths]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        for i, record in enumerate(self.records(partition.path)):
            yield (name, i, *record)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        droptail = self.options.get("mode", "failfast").lower() == "droptail"
        return _Reader(self.options, (".fastq", ".fq"), lambda p: fastq_records(p, droptail))


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        keep = self.options.get("keepempty", "false").lower() == "true"
        return _Reader(self.options, (".fasta", ".fa"), lambda p: fasta_records(p, keep))


def sequence_records(path: str) -> Iterator[tuple[str]]:
    """Sequences of a file, empty ones too; FASTA if its first character is >, else FASTQ."""
    records = fasta_records(path, keep_empty=True) if next(_lines(path), "").startswith(">") else fastq_records(path)
    return ((r[1],) for r in records)


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "file string, rec bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, (".fastq", ".fq", ".fasta", ".fa"), sequence_records)


def register(spark: SparkSession) -> None:
    for source in (FastqSource, FastaSource, SequenceSource):
        spark.dataSource.register(source)


def read_fastq(spark: SparkSession, path: str, mode: str = "failfast", skip_empty: bool = False) -> DataFrame:
    register(spark)
    out = spark.read.format("fastq").option("path", path).option("mode", mode).load()
    return out.where(F.length("seq") > 0) if skip_empty else out


def read_fasta(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").option("path", path).option("keepempty", str(keep_empty).lower()).load()


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, rec, seq of FASTQ or FASTA files, each as its own first character says."""
    register(spark)
    return spark.read.format("sequences").option("path", path).load()


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records (name, seq, qual) as a folder of FASTQ files, one a partition, in the order of its rows."""
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(record.alias("value")).write.option("compression", compression).text(path)


def write_fasta(reads: DataFrame, path: str, width: int = 80, compression: str = "none") -> None:
    """Records (name, seq) as a folder of FASTA files with lines of at most width letters."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value")).write.option("compression", compression).text(path)


def read_fastq_text(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file (its whole path), rec, seq by Spark's own text reader, for stores that only Spark reads.

    A plain file may be cut into blocks: a line's number is its place in its block, plus the lines of the blocks before.
    recursive: path is a folder, whose FASTQ files at any depth are read.
    """
    from pyspark.sql import Window

    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.f*q*") if recursive else spark.read
    rows = files.text(path).select(*block, F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file", "start").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    line = F.col("id") - F.col("low") + F.col("before")
    lines = rows.join(blocks, ["file", "start"]).withColumn("line", line)
    return lines.where("line % 4 = 1").select("file", F.floor(F.col("line") / 4).alias("rec"), F.trim("value").alias("seq"))


def first_records(reads: DataFrame, n: int) -> DataFrame:
    return reads.where(F.col("rec") < n)


def mate_and_run(file) -> tuple:
    """Columns srr and mate from names like SRR1_1.fastq.gz."""
    return F.regexp_extract(file, r"^(.*?)(?:_([12]))?\.f(?:ast)?q(?:\.gz)?$", 1).alias("srr"), F.coalesce(F.nullif(F.regexp_extract(file, r"_([12])\.f(?:ast)?q(?:\.gz)?$", 1), F.lit("")).cast("tinyint"), F.lit(1)).alias("mate")


def first_reads(files: DataFrame, suffix: str = ".fastq.gz") -> DataFrame:
    """file and mate_file of the files that are no second reads; mate_file is null where no second file of the run is listed."""
    ones = files.where(~F.col("file").endswith("_2" + suffix)).select("file")
    stem = F.when(F.col("file").endswith("_1" + suffix), F.expr(f"left(file, length(file) - {len(suffix) + 2})"))
    seconds = files.where(F.col("file").endswith("_2" + suffix)).select(F.col("file").alias("mate_file")).distinct()
    return ones.withColumn("__mate", F.concat(stem, F.lit("_2" + suffix))).join(seconds, F.col("__mate") == F.col("mate_file"), "left").select("file", "mate_file")


def files_of_runs(files: DataFrame, runs: DataFrame) -> DataFrame:
    """srr and file of the runs' files by their whole name, so that no run takes those of one whose name it begins."""
    named = files.select("file", mate_and_run(F.col("file"))[0]).where("srr <> ''")
    return runs.select("srr").distinct().join(named, "srr").select("srr", "file")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of the two files of a run side by side, by srr and record where both have srr; one without mate is an error."""
    keys = [c for c in ("srr", "rec") if c in first.columns and c in second.columns]
    a, b = first.select(*keys, "seq"), second.select(*keys, F.col("seq").alias("mate_seq"))
    both = a.join(b, keys, "full")
    bad = F.raise_error(F.lit("the files differ in their number of records")).cast("string")
    return both.select(*keys, F.when(F.col("mate_seq").isNull(), bad).otherwise(F.col("seq")).alias("seq"), F.when(F.col("seq").isNull(), bad).otherwise(F.col("mate_seq")).alias("mate_seq"))
