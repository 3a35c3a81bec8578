"""Operators do the whole job: cases that a floor, a cap or a window would leave out."""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import functions as F

from poolforge.llm import pii, quality_rules
from poolforge.plans import q_qc


def term_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_spans(df).collect()
    return {r.doc_id: {(s.start, s.end, s.value) for s in r.spans if s.kind == 4} for r in found}


def test_terms_of_an_entity_that_stands_once(spark):
    texts = ["write to Zebulon at unique@corp.example soon"] + ["please write to them soon"] * 60
    found = term_spans(spark, texts)
    assert found[0] == {(9, 16, "zebulon")}
    assert not any(found[i] for i in range(1, len(texts)))


def test_terms_far_from_their_entity(spark):
    far = "quiet words stand here " * 20
    texts = [f"Zebulon {far}secret@corp.example {far}said zebulon"] + [far] * 60
    found = term_spans(spark, texts)
    places = {(m.start(), m.end(), "zebulon") for m in re.finditer("(?i)zebulon", texts[0])}
    assert len(places) == 2 and places <= found[0]


def test_joint_counts_cover_whole_documents(spark):
    # Near the entity in one of its five texts, far from it in the others: all five tell.
    gap = " plain words of any text" * 10
    texts = [f"Zebulon secret@corp.example number{i}" if i == 0 else f"Zebulon{gap} secret@corp.example" for i in range(5)] + [gap] * 60
    found = term_spans(spark, texts)
    assert all((0, 7, "zebulon") in found[i] for i in range(5))


def test_places_of_many_matches(spark):
    text = " ".join(f"w\u00e9rd {i}" + "_" * (i % 3) for i in range(1000))
    df = spark.createDataFrame([(text,), ("",)], "text string")
    found = [r.m for r in df.select(pii.matches(F.col("text"), pii.TERM).alias("m")).collect()]
    assert [(x.start, x.end, x.value) for x in found[0]] == [(m.start(), m.end(), m[0]) for m in re.finditer("w\u00e9rd", text)]
    assert found[1] == []


def test_all_trusted_documents_count(spark):
    # One word for each half of the ids; the former bound of 16,384 ids left some of both out.
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("text"))
    docs = docs.unionByName(spark.range(n, 2 * n).select(F.col("id").alias("doc_id"), F.lit("raw").alias("text")))
    weights = {r.bucket: r.weight for r in quality_rules.log_ratio_table(docs, spark.range(n).select(F.col("id").alias("doc_id"))).collect()}
    prior = quality_rules.PRIOR
    for word, target, raw in (("even", n // 2, n // 2), ("odd", n // 2, n // 2), ("raw", 0, n)):
        expected = raw * n / (2 * n)
        ratio = math.log((target + prior) / (expected + prior))
        assert weights[zlib.crc32(word.encode()) % quality_rules.BUCKETS] == round(ratio * quality_rules.SCALE)


def test_q01_draws_as_many_reads_as_the_smallest_round_has(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id as l_orderkey", "cast(1 + id % 2 as int) as l_linenumber", "id div 2 as l_partkey", "1L as l_suppkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.round: r.uniques for r in q_qc.q01(spark, str(tmp_path)).collect()} == {1: 600, 2: 600}


def test_stored_plans_run_in_small_batches_and_give_the_setting_back(spark):
    from poolforge.llm.common import BATCH_ROWS, stored

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    found = [r.n for r in stored(spark.range(0, 2_000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 2_000 and max(found) <= BATCH_ROWS
    assert spark.conf.get(name) == before
