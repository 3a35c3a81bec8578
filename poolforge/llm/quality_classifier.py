"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are lower-cased words and runs of other marks. Single tokens and neighbouring pairs are hashed to ``2 ** bits``
weights; a text's distinct hashes have the value 1/sqrt(their number). Each token also has a shape (lower case, capital,
capitals, stop, other mark, repeat of the token before, digits), and the pairs of neighbouring shapes are n-grams too,
hashed with the root of their share as value; they carry over to words that training never saw. A score is one sparse dot product.

Training reads a bounded sample of labelled rows on the driver, one row at a time in an order given by a hash of
the id; scoring is one pass over the documents with the weights broadcast (their size is fixed by ``bits``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored

BITS, SAMPLE, UPDATES = 18, 8_000, 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1
#: Tokens whose hashes a worker remembers; a full memo is emptied.
MEMO = 400_000
LOWER, CAPITAL, CAPITALS, STOP, MARK, REPEAT, DIGITS, SHAPES = range(8)
#: Weight of the shape n-grams beside the words.
SHAPE_GAIN = 3.0
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall


def _shape(token: str) -> int:
    if token.isalpha():
        return LOWER if token.islower() else CAPITALS if len(token) > 1 and token.isupper() else CAPITAL
    return STOP if token in {".", ",", ";", ":", "?", "!", "'", "-"} else DIGITS if token[0].isalnum() else MARK


class Hasher:
    """Sparse features of a text: places and values."""

    def __init__(self, bits: int = BITS):
        self.mask, self.memo = np.uint64((1 << bits) - 1), {}
        self.shape_places = np.array([crc32(b"\x00shape %d" % k) for k in range(SHAPES * SHAPES)], np.int64) & ((1 << bits) - 1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens, memo = _TOKEN(text or ""), self.memo
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        hashes = []
        for t in tokens:
            h = memo.get(t)
            if h is None:
                if len(memo) >= MEMO:
                    memo.clear()
                h = memo[t] = crc32(t.lower().encode()) | _shape(t) << 32
            hashes.append(h)
        full = np.array(hashes, np.uint64)
        h = full & np.uint64(0xFFFFFFFF)
        mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)
        places = np.unique(np.concatenate([mixed, pairs]) & self.mask).astype(np.int64)
        values = np.full(len(places), 1 / np.sqrt(len(places)))
        shapes = (full >> np.uint64(32)).astype(np.int64)
        shapes[1:][h[1:] == h[:-1]] = REPEAT
        counts = np.bincount(np.append(shapes[:1], shapes[:-1]) * SHAPES + shapes, minlength=SHAPES * SHAPES)
        there = np.flatnonzero(counts)
        return np.append(places, self.shape_places[there]), np.append(values, SHAPE_GAIN * np.sqrt(counts[there] / len(tokens)))


def train(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int = BITS, updates: int = UPDATES) -> np.ndarray:
    """FTRL-proximal over (features, label) rows in the given order, again until ``updates``; the last weight is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(max(1, min(40, updates // max(1, len(rows))))):
        for (places, values), label in rows:
            i, x = np.append(places, size - 1), np.append(values, 1.0)
            w = _weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return _weights(z, n).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, each: int) -> DataFrame:
    """text and label of at most ``each`` training rows of either label: those with the smallest md5 of the id.

    Rows of the held-out fold, and rows without id or label, are left out; an id labelled twice counts once, by its
    larger label. The ids are at most 2 * each, so their broadcast is bounded.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(~in_fold(folds, held_out)).withColumn("__order", F.md5(F.col("doc_id").cast("string")))
    parts = [known.where(F.col("label") == v).orderBy("__order", "doc_id").limit(each) for v in (0, 1)]
    return only(docs, "doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("__order", "doc_id", "text", "label")


def in_fold(folds: int, held_out: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, folds: int = 5, held_out: int = 0) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows (label column quality) outside the held-out fold.

    Either label gives at most half of the sample; the intercept is then moved to the labels' shares among all training rows.
    """
    hasher, rows = Hasher(bits), []
    for r in labelled_sample(docs, labels, "quality", folds, held_out, sample // 2).toLocalIterator():
        rows.append((r["__order"], r.doc_id, hasher(r.text), r.label))
    rows.sort(key=lambda r: r[:2])
    weights = train([r[2:] for r in rows], bits)
    there = {r.quality: r.n for r in labels.where(~in_fold(folds, held_out)).groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count("doc_id").alias("n")).collect()}
    taken = [sum(r[3] == k for r in rows) for k in (0, 1)]
    if all(taken) and there.get(0) and there.get(1):
        weights[-1] += np.log(there[1] / there[0]) - np.log(taken[1] / taken[0])
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score for each row; texts are taken whole, a null or empty one scores by the intercept alone."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shared.value, Hasher(bits)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                places, values = hasher(text)
                out.append(float(w[places] @ values) + float(w[-1]))
            scores = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = only(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; extra columns are never read.

    Without any labelled row every score is 0.5. Ties, repeated rows and null ids are scored row by row.
    """
    weights = fit(docs, labels, sample, folds=folds, held_out=held_out)
    return stored(score(docs, weights), "quality_scores").select("doc_id", in_fold(folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
