"""Comparison of two output trees, and the table of parameters."""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of names of fields that change with every run, and endings of files that are never compared.
VOLATILE = ("created_at", "timestamp", "seconds", "elapsed", "version", "git", "duration", "date", "runtime")
IGNORED = r"\.(log|png|parquet|crc)$"


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """Path and JSON text of every scalar and empty container within a value."""
    inner = [(f"{path}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else []
    if not inner:
        yield path, json.dumps(value)
    for at, v in inner:
        yield from leaves(v, at)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """file, path and value of the files under root: each leaf of a JSON file, the digest of any other (unpacked, if gzip).

    The root's own name within JSON texts reads ROOT. Parquet is left out, as its bytes are not stable: compare its rows.
    """
    base = root.removeprefix("file://").rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                if file.endswith(".json"):
                    rows += [(file, p, v) for p, v in leaves(json.loads(content.decode().replace(base, "ROOT")))]
                else:
                    whole = gzip.decompress(content) if file.endswith(".gz") else content
                    rows.append((file, "", hashlib.sha256(whole).hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "path", "value"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.select(F.element_at(F.split("path", F.lit(f"\\Q{base}/\\E"), 2), -1).alias("file"), "content")
    return found.where(~F.col("file").rlike(IGNORED)).mapInPandas(run, "file string, path string, value string")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, path, kind (MISSING, EXTRA or DIFFERS), old and new of what two trees (contents) do not share, but for volatile fields."""
    a, b = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    both = a.join(b, ["file", "path"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("new").isNull(), "MISSING").when(F.col("old").isNull(), "EXTRA").otherwise("DIFFERS")
    return both.where(~F.lower("path").rlike("|".join(VOLATILE))).select("file", "path", kind.alias("kind"), "old", "new")


def parameters(spark: SparkSession) -> DataFrame:
    """stage, name and value of the constants that steer inference, trimming and quality checks, as the modules hold them."""
    from ..operators import inference, profiles, qc, signals, trimming

    rows = []
    for stage, module in (("detect", inference), ("detect", signals), ("profile", profiles), ("extract", trimming), ("qc", qc)):
        rows += [(stage, k, json.dumps(v)) for k, v in vars(module).items() if k.isupper() and not k.startswith("_") and isinstance(v, (int, float, str, dict, tuple))]
    return spark.createDataFrame(sorted(set(rows)), "stage string, name string, value string")
