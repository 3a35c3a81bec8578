"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words by its weight, at most ``cap`` times what it has; the excess is shared again
among the others. A document of a source with target / size = e is taken floor(e) times for sure and once more with
probability e - floor(e), which is the same for all documents of the source. These last copies are drawn by the cube
method: the vector of inclusion probabilities moves within the null-space of the balancing constraints (words and
documents) until its entries are 0 or 1, so words and documents taken stay at their expected totals. Three open
units always have a null vector (a cross product), so one flight step settles at least one of them.

At scale a source is cut into blocks of bounded size by a hash of the id. Each block flies by itself and leaves at most
two open units; these are blocked again and fly again, round after round, until each source is one block. Its
flight holds back ``LANDING`` units, half of them the largest and half drawn by hash; these and the open ones are the landing problem, whose nearest solution
is found by trying all, so a source misses its target by a few words. All draws come from hashes of ids, so reruns agree. A hot source has more blocks, not larger ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, row_key, stored

#: Units that one task flies at most, about.
BLOCK = 4_096
#: Units held back for the landing.
LANDING = 14
#: A probability this near to 0 or 1 is settled.
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), cap: float = 3.0, share: float = 1.0) -> dict[str | None, float]:
    """Words to take from each source. Sources by code point, null last, weigh weights[0], weights[1], ..., repeating.

    All sources share ``share`` of all words by weight; one above cap times its size stays there, and its excess goes to
    the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        rest -= sum(cap * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def flight(chance: np.ndarray, constraints: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities along null vectors of two constraints until at most two are open.

    constraints: two rows, what a unit adds to either total divided by its probability.
    """
    p, draws = chance.copy(), rng.random(len(chance))
    first, second = constraints
    open_units: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            open_units.append(k)
        while len(open_units) == 3:
            i, j, l = open_units  # noqa: E741
            u = (
                first[j] * second[l] - first[l] * second[j],
                first[l] * second[i] - first[i] * second[l],
                first[i] * second[j] - first[j] * second[i],
            )
            if not any(u):  # the constraints agree on these units: any vector that keeps the first will do
                u = (first[j], -first[i], 0.0) if first[i] or first[j] else (1.0, -1.0, 0.0)
            up = down = math.inf
            for unit, step in zip(open_units, u, strict=True):
                if step > 0:
                    up, down = min(up, (1 - p[unit]) / step), min(down, p[unit] / step)
                elif step < 0:
                    up, down = min(up, -p[unit] / step), min(down, -(1 - p[unit]) / step)
            move = up if draws[k] * (up + down) < down else -down
            for unit, step in zip(open_units, u, strict=True):
                p[unit] = min(1.0, max(0.0, p[unit] + move * step))
            left = [unit for unit in open_units if EPS < p[unit] < 1 - EPS]
            if len(left) == 3:  # rounding: settle the nearest one
                near = min(left, key=lambda unit: min(p[unit], 1 - p[unit]))
                p[near] = round(p[near])
                left.remove(near)
            open_units = left
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle a few open units: of all ways to take them, the one nearest to their expected words, then documents."""
    k = len(p)
    ways = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    words, count = np.abs(ways @ size - p @ size), np.abs(ways.sum(axis=1) - p.sum())
    return ways[np.lexsort((count, np.round(words, 6)))[0]].astype(np.float64)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the units of a block; a source's only block is landed too."""
    pdf = pdf.drop(columns="__block").sort_values(["draw", "key"], kind="stable").reset_index(drop=True)
    land = pdf["blocks"].iloc[0] == 1
    rng = np.random.default_rng([int(np.bitwise_xor.reduce(pdf["draw"].to_numpy(np.int64))) & 0x7FFFFFFF, len(pdf)])
    p, size = pdf["chance"].to_numpy(np.float64).copy(), pdf["size"].to_numpy(np.float64)
    open_units = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = open_units[np.argsort(-size[open_units], kind="stable")]
    kept = np.union1d(by_size[: LANDING // 2], open_units[: LANDING // 2]) if land else open_units[:0]
    rest = np.setdiff1d(np.arange(len(p)), kept)
    p[rest] = flight(p[rest], np.vstack([size[rest], np.ones(len(rest))]), rng)
    if land:
        left = np.flatnonzero((p > 0) & (p < 1))
        p[left] = landing(p[left], size[left])
    return pdf.assign(chance=p)


def mix_sources(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, share: float = 1.0, block: int = BLOCK) -> DataFrame:
    """key, doc_id, source, size, source_size, target and copies (how often the mix takes it) for each row of docs.

    size: words of the text, 0 for null. Rows of size 0 keep their source's chance, and count as documents. Repeated rows
    are units of their own; a null source is a source. An empty table gives an empty result. Extra columns only count in
    key, a hash of the row.
    Only the sources' totals come to the driver; their number must fit there.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")
    units = docs.select(row_key(docs).alias("key"), F.col("doc_id"), F.col("source"), size.alias("size"))
    units = stored(units, "mix_units")
    total = {r.source: (r.words, r.n) for r in units.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()}
    goal = targets({s: w for s, (w, _) in total.items()}, weights, cap, share)
    plan = [(s, w, float(goal[s]), goal[s] / w if w else 0.0, max(1, math.ceil(n / block))) for s, (w, n) in total.items()]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, rate double, blocks int")
    units = units.join(plan, units["source"].eqNullSafe(plan["source"])).select(units["*"], "source_size", "target", "rate", "blocks")
    whole = F.floor(F.col("rate") + EPS)
    draw = F.xxhash64("key", F.lit(8))
    units = units.select("key", "doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("chance"), draw.alias("draw"), "blocks")

    schema, done = units.schema, []
    most = max([math.ceil(n / block) for _, n in total.values()], default=1)
    pending, turn = units, 0
    while True:
        last = most == 1
        place = F.pmod(F.xxhash64("key", "draw", F.lit(turn)), F.col("blocks"))
        groups = pending.withColumn("__block", place.cast("int"))
        flown = groups.groupBy("source", "__block").applyInPandas(_fly, schema)
        if last:
            done.append(flown)
            break
        flown = stored(flown, "mix_flight")
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(flown.where(settled))
        # At most two units of a block are still open: the next round needs that many fewer blocks.
        pending = flown.where(~settled).withColumn("blocks", F.greatest(F.ceil(F.col("blocks") * 2 / block), F.lit(1)).cast("int"))
        most, turn = math.ceil(most * 2 / block), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("key", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("chance")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; equal rows stand together as often as the mix takes all of them."""
    copies = mix_sources(docs, **options).groupBy(F.col("key").alias("__key")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n"))
    columns = [f"`{c}`" for c in docs.columns]
    rows = docs.withColumn("__key", row_key(docs)).join(copies, "__key").select(*columns, "__key", "__copies", "__n")
    rows = rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["__key"]))
    return rows.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for each row of docs."""
    mixed = mix_sources(docs, **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
