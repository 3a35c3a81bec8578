"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on the full shingle sets.

Two collections of minhash groups are computed, U with ``U_GROUPS`` groups of ``U_WIDTH`` minhashes and V with
``V_GROUPS`` of ``V_WIDTH``. A table key is a pair of one group from either, so U_GROUPS * V_GROUPS tables of width U_WIDTH +
V_WIDTH cost only U_GROUPS * U_WIDTH + V_GROUPS * V_WIDTH minhashes. Pairs are formed only where the U group is shared at all.
At a similarity of 0.8 a pair meets in no table with a probability of 5e-5.

Documents with equal sets are one vertex, their smallest id. A bucket never gives all its pairs. First each vertex is
compared with the smallest vertex that it meets in any bucket; connected components follow. What remains are buckets
that hold more than one component. Vertices that such buckets tie together form a group, and every two members of a group
from different components are compared on their full sets: a task takes two blocks of bounded size and counts common
shingles by an inverted index, so that it returns no pairs but only the links that join two components. So any two documents
that met are compared or already connected, and components equal those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, discard, only, stored
from .graph import components

U_GROUPS, U_WIDTH, V_GROUPS, V_WIDTH = 16, 3, 10, 2
PERCENT, SHINGLE = 80, 2
#: Documents that one task compares with as many others at a time.
BLOCK = 2_048
LAST = (1 << 63) - 1


class Shingler:
    """Distinct shingle hashes of a text, and its minhash groups."""

    def __init__(self, width: int = SHINGLE):
        import xxhash

        self.width, self.memo, self.wide_hash = width, HashMemo(xxhash.xxh3_64_intdigest), xxhash.xxh3_128_digest
        rng = np.random.default_rng(2)
        count = U_GROUPS * U_WIDTH + V_GROUPS * V_WIDTH
        self.factors = rng.integers(1, 1 << 63, count, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = self.memo.array((text or b"").lower().split())
        if not len(h):
            return h
        width = min(self.width, len(h))  # a shorter text is one shingle
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total = (total ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        return np.unique(total)

    def groups(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit value for each group of minhashes, U before V."""
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for i in range(0, len(shingles), 2048):
            part = shingles[None, i : i + 2048] * self.factors + self.offsets
            np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=1), out=least)
        cut = U_GROUPS * U_WIDTH
        out = []
        for part, width in ((least[:cut], U_WIDTH), (least[cut:], V_WIDTH)):
            total = np.zeros(len(part) // width, np.uint64)
            for i in range(width):
                total = (total ^ part[i::width]) * np.uint64(0xD6E8FEB86659FD93)
                total ^= total >> np.uint64(29)
            out.append(total)
        return np.concatenate(out).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    return only(docs, "doc_id", "text").select(doc, F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc, row, n_shingles, a 128-bit digest of the set (two longs) and its minhash groups, for each row."""
    import pyarrow as pa


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(shingle)
        for batch in batches:
            sizes, digests, groups = [], [], []
            for text in batch.column("text").to_pylist():
                s = sets(text)
                sizes.append(len(s))
                digests.append(np.frombuffer(sets.wide_hash(s.tobytes()), np.int64))
                groups.append(sets.groups(s) if len(s) else np.empty(0, np.int64))
            two = np.array(digests, np.int64).reshape(-1, 2)
            columns = [batch.column("doc"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(groups, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "row", "n_shingles", "d1", "d2", "groups"])

    return _keyed(docs).mapInArrow(run, "doc long, row long, n_shingles long, d1 long, d2 long, groups array<long>")


def _met(table: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in two rows or more."""
    often = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return table.join(often, key, "left_semi")


def buckets(vertices: DataFrame) -> DataFrame:
    """key, doc and row: the vertices of every table bucket with two or more of them."""
    u = vertices.select("doc", "row", F.slice("groups", U_GROUPS + 1, V_GROUPS).alias("v"), F.posexplode(F.slice("groups", 1, U_GROUPS)).alias("i", "g"))
    u = u.select("doc", "row", "v", F.xxhash64("i", "g").alias("ukey"))
    shared = u.groupBy("ukey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ukey")
    u = u.join(shared, "ukey", "left_semi")
    pairs = u.select("doc", "row", F.posexplode("v").alias("j", "h"), "ukey").select("doc", "row", F.xxhash64("ukey", "j", "h").alias("key"))
    return _met(pairs, "key")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """u and v of the pairs (u, urow, v, vrow) whose full sets have 100 * intersection >= percent * union."""
    import pyarrow as pa

    left = texts.select(F.col("row").alias("urow"), F.col("text").alias("utext"))
    right = texts.select(F.col("row").alias("vrow"), F.col("text").alias("vtext"))
    rows = pairs.join(right, "vrow").join(left, "urow").select("u", "v", "urow", "utext", "vtext")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, last, kept = Shingler(shingle), None, None
        for batch in batches:
            good = []
            for row, a, b in zip(*[batch.column(c).to_pylist() for c in ("urow", "utext", "vtext")], strict=True):
                if row != last:
                    last, kept = row, sets(a)
                other = sets(b)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _join_block(percent: int, shingle: int):
    """Links between the components of two blocks (i, j) of a group; rows: doc, label, side (block), i, j, text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = Shingler(shingle)
        labels, docs = pdf["label"].to_numpy(np.int64), pdf["doc"].to_numpy(np.int64)
        shingles = [sets(t) for t in pdf["text"]]
        sizes = np.array([len(s) for s in shingles])
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(pdf["side"] == i), np.flatnonzero(pdf["side"] == j)
        flat = np.concatenate([shingles[k] for k in right]) if len(right) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(right)), sizes[right])
        order = np.argsort(flat, kind="stable")
        keys, starts = np.unique(flat[order], return_index=True)
        owner, ends = owner[order], np.append(starts[1:], len(flat))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        out = []
        for k in left if len(keys) else ():
            at = np.searchsorted(keys, shingles[k])
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == shingles[k])]
            if not len(at):
                continue
            first, count = starts[at], ends[at] - starts[at]
            spread = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(owner[spread], minlength=len(right))
            near = np.flatnonzero((100 * both >= percent * (sizes[k] + sizes[right] - both)) & (labels[right] != labels[k]))
            for m in right[near]:
                a, b = top(int(labels[k])), top(int(labels[m]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((docs[k], docs[m]))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def remaining_links(open_rows: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """u and v: links that join components of documents which an open bucket ties together; open_rows: key, doc, row, label."""
    ties = open_rows.groupBy("key").agg(F.min("doc").alias("u"))
    groups = components(open_rows.join(ties, "key").select("u", F.col("doc").alias("v")))
    members = open_rows.groupBy("doc", "row").agg(F.min("label").alias("label"))
    members = members.join(groups, members["doc"] == groups["node"]).select("doc", "row", members["label"], groups["label"].alias("g"))
    sizes = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "g").withColumn("side", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.join(texts, "row").select("g", "doc", "label", "side", "text", other.alias("o"))
    pairs = pairs.select("g", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "doc", "label", "side", "text")
    return pairs.groupBy("g", "i", "j").applyInPandas(_join_block(percent, shingle), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) for each row of docs.

    Words are split at white space, A-Z in lower case. A text with fewer words than a shingle is one shingle; one without
    words, or null, has no shingles and no links. Rows that share an id are one vertex; rows without id are compared with
    nothing, stay, and have a null component_id. An empty table gives an empty result.
    """
    found = stored(signatures(docs, shingle), "signatures")
    some = found.where(F.col("n_shingles") > 0).where(F.col("doc") < LAST)
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc", "row")).alias("head"), F.min("groups").alias("groups"))
    # A number by an expression: classes are dealt for joins by an exchange of their own, so that the rows of a large class can be split.
    apart = F.bitwise_not(F.bitwise_not("d1")).alias("d1")
    vertices = classes.select(F.col("head.doc").alias("doc"), F.col("head.row").alias("row"), "groups")
    table = stored(buckets(vertices), "buckets")
    needed = table.select("row").distinct()
    texts = stored(_keyed(docs).select("row", "text").join(needed, "row", "left_semi").groupBy("row").agg(F.min("text").alias("text")), "bucket_texts")

    # Round one: each vertex with the smallest one that it meets anywhere.
    heads = table.groupBy("key").agg(F.min(F.struct("doc", "row")).alias("head"))
    nearest = table.join(heads, "key").groupBy("doc", "row").agg(F.min("head").alias("head"))
    pairs = nearest.where(F.col("head.row") != F.col("row")).select(F.col("head.doc").alias("u"), F.col("head.row").alias("urow"), F.col("doc").alias("v"), F.col("row").alias("vrow"))
    # Rows with different sets under one id are one vertex, so their classes are linked without a test.
    same = classes.select(apart, "d2", "head").join(some.select("d1", "d2", "doc"), ["d1", "d2"]).where(F.col("doc") != F.col("head.doc")).select(F.col("head.doc").alias("u"), F.col("doc").alias("v")).distinct()
    repeated = some.groupBy("doc").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select(F.col("doc").alias("v"))
    edges = stored(confirmed(pairs, texts, percent, shingle).unionByName(same.join(repeated, "v", "left_semi").select("u", "v")), "links")
    labels = components(edges)
    marked = table.join(labels, table["doc"] == labels["node"], "left").select("key", "doc", "row", F.coalesce("label", "doc").alias("label"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    open_rows = stored(marked.join(mixed, "key", "left_semi"), "open_buckets")
    new = stored(remaining_links(open_rows, texts, percent, shingle), "links")
    labels = components(edges.unionByName(new))
    discard(table, texts, open_rows, edges, new)
    heads = classes.select(apart, "d2", F.col("head.doc").alias("rep"))
    # Rows without words or id are alone, and share no key in the join.
    member = (F.col("n_shingles") > 0) & (F.col("doc") < LAST)
    rows = found.where(member).join(heads, ["d1", "d2"], "left")
    rows = rows.join(labels, rows["rep"] == labels["node"], "left").select("doc", "n_shingles", F.coalesce("label", "rep").alias("c"))
    # An id without words in one row may have words in another.
    alone = found.where(~member).select("doc", "n_shingles", F.col("doc").alias("c"))
    rows = rows.unionByName(alone)
    shown = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return rows.select(shown("doc").alias("doc_id"), "n_shingles", shown("c").alias("component_id"), (F.col("doc") == F.col("c")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id (none last); all columns are kept.

    Here every text is a document, whether or not it has an id of its own: rows that share an id and differ are compared like
    others. Of rows with equal id and text one stays. Texts without words are like nothing, and stay.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    each = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    groups = near_duplicates(each.select(key.alias("doc_id"), "text"), percent, shingle).select(F.col("doc_id").alias("key"), F.col("component_id").alias("c"))
    ids = each.groupBy(key.alias("key")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "key")
    heads = groups.distinct().join(ids, "key").groupBy("c").agg(F.min(F.struct(order.alias("order"), "n")).alias("head"))
    heads = heads.select(F.col("head.order.key").alias("__key"), F.col("head.n").alias("__n"))
    kept = docs.withColumn("__key", key).join(heads, "__key").select(*[f"`{c}`" for c in docs.columns], "__key", "__n")
    several = kept.where("__n > 1").dropDuplicates(["__key"])
    return kept.where("__n = 1").unionByName(several).drop("__key", "__n")
