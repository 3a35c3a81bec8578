"""Corpus pipeline over `documents`: quality rules, near-duplicates, personal data, mixing of sources, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever further columns there are and whatever their names.
Rows, not ids, are documents: rows without id and rows that share one are judged, compared, masked and mixed by themselves.
An empty table passes all stages as an empty one. No SQL states all stages, so ORACLE_SQL is None, and the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolforge.llm.byte_bpe import round_trip_digests
from poolforge.llm.common import discard, read_table, stored
from poolforge.llm.near_dedup import without_near_duplicates
from poolforge.llm.pii import sanitised
from poolforge.llm.quality_rules import kept_documents
from poolforge.llm.source_mix import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted are those of quality 1 in `labels`.

    Null, empty and short texts go. Repeated rows are judged alike, so all or none of them stay; there are no ties.
    """
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return kept_documents(docs, trusted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays, a null one last; ties go by a hash of the text. Of equal rows one stays. Texts without
    words are like nothing and stay, one for each id.
    """
    return without_near_duplicates(docs, percent=80, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and revealing terms generalised; null texts stay null, no row goes or comes."""
    return sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; a null source is a source, a null text has no words."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id and source, its tokens as their number and digests, and the digest of the decoded bytes; null: empty."""
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("source mix", mix), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
