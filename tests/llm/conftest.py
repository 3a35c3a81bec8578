"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
CLASH = ("words", "row", "doc", "label", "hash", "size", "kept")


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeiorst", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    out = [(i, passage(i, rng.randint(5, 160)), "en", f"src{i % 3}", 0) for i in range(60)]
    shared = passage(999, 40)
    out += [(60 + i, passage(500 + i, 30) + " " + shared + " " + passage(600 + i, 30), "en", "src0", 0) for i in range(12)]
    base = passage(1234, 150).split()
    for i in range(20):  # near copies
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(150)] = f"edit{i}"
        out.append((80 + i, " ".join(words), "en", "src1", 0))
    out += [(100 + i, out[3][1].upper() if i == 1 else out[3][1], "en", "src2", 0) for i in range(3)]
    out += [(110, None, None, None, None), (111, "", "en", "src0", 0), (112, " \t\n ", "en", None, 3), (113, "one", "en", "src0", 3), (114, "One", "en", "src0", 3), (115, "two words", "en", "src0", 9)]
    out += [(116, passage(77, 6000), "en", "src0", 0), (117, "loop the loop " * 50, "en", "src0", 0), (118, passage(3, 10) + "\n\n" + passage(3, 10) + "\n#$%\n", "en", "src2", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("extra"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
