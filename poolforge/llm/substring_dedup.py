"""Removal of repeated passages, with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. A word goes if a window that covers it also starts in a document with a
smaller id. Documents come in batches of ascending ids. Workers fingerprint a batch's windows and pack what they find by
hash range; each range is merged by hash with the immutable, sorted runs of the batches before: of equal windows the
smallest id is the first place, every other document's window is a repeat. A fingerprint has 64 bits and is verified
by 32 bits made from another, independent hash of the same words. Each batch's first places become a new run; runs are
compacted into one when there are too many of them for the next merge.

Not every window needs an entry. Of the 5-word grams of a window the smallest hash is its anchor; equal windows have
equal anchors, and neighbouring windows mostly share theirs. A first pass finds the anchors that stand in two documents
at least and puts them into a Bloom filter that is sized by their number; only windows whose anchor passes are entered.
The filter has ``MOST_FILTER_BITS`` at most, as it is broadcast. Beyond that it lets more windows through and loses none:
in the limit each window has an entry of about 14 bytes, which is linear in the input.

Workers compare a chunk's windows among themselves first: a repeat within the chunk is known at once, and only first
places go on. So a passage that a third of all documents share gives one entry for each chunk, not for each document.
Repeats go back to their documents as places, not hashes, so that texts are not fingerprinted again; only texts that
have a repeat are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bit_filter, discard, in_filter, only, pack, release, stored, unpack

WINDOW, GRAM = 13, 5
#: The largest Bloom filters of anchors and of documents, which are broadcast: 128 MB and 16 MB.
MOST_FILTER_BITS, MOST_DOC_BITS = 30, 27
#: Windows that a worker compares among themselves at a time, and words that it hashes at a time.
CHUNK, SPAN = 600_000, 200_000
#: Bytes of text for each hash range.
RANGE_BYTES = 16 << 20
#: Runs that a batch is merged with at most.
MOST_RUNS = 1
#: Shares of the documents at which the batches end.
CUTS = (0.0625, 0.125)
LAST = (1 << 63) - 1
ENTRY = "kind int, range int, hash binary, check binary, doc binary, key binary, place binary, old boolean"
#: Kinds of rows: places of repeats, windows to be merged, and further places of a document's windows.
PLACES, FIRSTS, TWINS = 0, 1, 2
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of all sequences of some length, as differences of running sums with weights factor ** i modulo 2 ** 64."""

    def __init__(self, factor: int):
        self.factor, self.inverse = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray, length: int) -> np.ndarray:
        n = len(h)
        if len(self.powers) < n:
            self.powers, self.inverses = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, f, np.uint64)]) for f in (self.factor, self.inverse))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.powers[:n], out=total[1:])
        return _mixed((total[length:] - total[: n + 1 - length]) * self.inverses[: n + 1 - length])


class Fingerprints:
    """Hashes of words, anchors and windows, for many texts at a time."""

    def __init__(self):
        self.table, self.roll, self.check_roll = WordTable(), Rolling(_A), Rolling(_B)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Two independent hashes of each word, and text, first word and place in the text of each window."""
        words = [t.split() for t in texts]
        low, high = self.table.arrays(words)
        sizes = np.array([len(w) for w in words], np.int64)
        counts = np.maximum(0, sizes - WINDOW + 1)
        which = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return low, high, which, place + np.repeat(np.cumsum(sizes) - sizes, counts), place

    def anchors(self, low: np.ndarray) -> np.ndarray:
        """The anchor of the window that starts at each word."""
        out = self.roll(low, GRAM)
        reach = WINDOW - GRAM + 1
        for step in (1, 2, 4, reach - 8):
            out = np.minimum(out[: len(out) - step], out[step:])
        return _mixed(out)  # least hashes are small; mixed again, they fill ranges and filters evenly

    def windows(self, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.roll(low, WINDOW)[at], (self.check_roll(high, WINDOW)[at] >> np.uint64(32)).astype(np.uint32)


def _rows(docs: DataFrame) -> DataFrame:
    """Id (a null one counts as larger than all) and text."""
    return only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _blocks(batches: Iterator, columns: tuple[str, ...]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in blocks of about SPAN words."""
    rest, texts, size = [], [], 0
    for batch in batches:
        for values in zip(*[batch.column(c).to_pylist() for c in columns], batch.column("text"), strict=True):
            rest.append(values[:-1])
            texts.append(values[-1].as_py())
            size += len(texts[-1])
            if size > SPAN * 7:
                yield rest, texts
                rest, texts, size = [], [], 0
    if texts:
        yield rest, texts


def _cut(sorted_hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Range and slice of the hashes in each of the equal ranges that has some."""
    shift = np.uint64(64 - ranges.bit_length() + 1)
    which = (sorted_hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(sorted_hashes), np.int64)
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else []
    for a, b in zip(starts, [*starts[1:], len(which)], strict=True):
        yield int(which[a]), slice(int(a), int(b))


def shared_anchors(rows: DataFrame, ranges: int) -> DataFrame:
    """range, n and hashes (sorted, packed) of the anchors that stand in two rows or more; rows: doc and text.

    Rows with one id count as one document within a chunk only; an anchor that passes for nothing does no harm.
    """
    import pyarrow as pa

    def found(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, d = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(new)
        several = d[starts] != d[np.r_[starts[1:] - 1, len(h) - 1]]
        h = h[starts]
        out = [(r, h[s][~several[s]].tobytes(), h[s][several[s]].tobytes()) for r, s in _cut(h, ranges)]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2)]], ["range", "one", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, parts, held = Fingerprints(), [], 0
        for ids, texts in _blocks(batches, ("doc",)):
            low, _, which, at, _ = prints.of(texts)
            if not len(at):
                continue
            a, d = prints.anchors(low)[at], np.array([i[0] for i in ids], np.int64)[which]
            change = np.ones(len(a), bool)
            change[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            parts.append((a[change], d[change]))
            held += len(parts[-1][0])
            if held > CHUNK // 3:
                yield found(parts)
                parts, held = [], 0
        if parts:
            yield found(parts)

    def shared(table: pa.Table) -> pa.Table:
        ones = np.sort(np.frombuffer(b"".join(table["one"].to_pylist()), np.uint64))
        twice = ones[1:][ones[1:] == ones[:-1]]
        several = np.frombuffer(b"".join(table["several"].to_pylist()), np.uint64)
        both = np.unique(np.concatenate([twice, several]))
        return pa.table({"range": table["range"][:1], "n": pa.array([len(both)], pa.int64()), "hashes": pa.array([both.tobytes()], pa.binary())})

    packed = rows.mapInArrow(run, "range int, one binary, several binary")
    return packed.groupBy("range").applyInArrow(shared, "range int, n long, hashes binary")


def _by_window(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns (hash and check first) sorted so that equal windows are neighbours, and where a window begins."""
    h, c = columns[:2]
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    check = c[order]
    if (check != check[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]).any():  # a hash of two windows
        order = np.lexsort((c, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    for i, x in enumerate(columns):
        columns[i] = x[order]
    return columns, new


def _least(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The least value of each window, for each of its rows."""
    return np.minimum.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1] if len(values) else values


def _settled(parts: list[tuple], ranges: int):
    """Entries of a chunk's windows: first places by hash range, and places of the repeats within the chunk."""
    import pyarrow as pa

    columns = [np.concatenate([part[i] for part in parts]) for i in range(5)]
    parts.clear()
    (h, c, d, k, p), new = _by_window(columns)
    first = d == _least(d, new)
    out = _places(d[~first], k[~first], p[~first], ranges)
    # A window that a text repeats has one entry; its other places go straight to the document, tied to the first.
    window = np.cumsum(new)[first]
    h, c, d, k, p = (x[first] for x in (h, c, d, k, p))
    again = np.zeros(len(h), bool)
    again[1:] = (window[1:] == window[:-1]) & (d[1:] == d[:-1])
    if again.any():
        some = again.copy()
        some[:-1] |= again[1:]
        rows = np.flatnonzero(some)
        rows = rows[np.lexsort((p[rows], k[rows], window[rows]))]
        head = np.ones(len(rows), bool)
        head[1:] = (window[rows][1:] != window[rows][:-1]) | (k[rows][1:] != k[rows][:-1])
        heads = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        out += _places(d[rows][~head], k[rows][~head], p[heads][~head], ranges, p[rows][~head])
        keep = ~some
        keep[rows[head]] = True
        h, c, d, k, p = (x[keep] for x in (h, c, d, k, p))
    out += [_entry(FIRSTS, r, h[s], c[s], d[s], k[s], p[s], False) for r, s in _cut(h, ranges)]
    return pa.RecordBatch.from_pylist(out, _schema())


def _schema():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ENTRY.split(", ")])


def _entry(kind: int, which: int, h, c, d, k, p, old: bool) -> dict:
    """One row of packed entries; keys that are all 0 are left out."""
    pair = {"hash": h.tobytes(), "check": c.tobytes()} if h is not None else {"hash": None, "check": None}
    key = k.tobytes() if k is not None and k.any() else None
    return {"kind": kind, "range": which, **pair, "doc": pack(d), "key": key, "place": pack(p) if p is not None else None, "old": old}


def _deal(d: np.ndarray, k: np.ndarray, ranges: int) -> np.ndarray:
    """The range that gathers the places of a document."""
    return (_mixed((d.view(np.uint64) ^ _mixed(k.view(np.uint64))) * np.uint64(_A)) % np.uint64(ranges)).astype(np.int64)


def _places(d: np.ndarray, k: np.ndarray, p: np.ndarray, ranges: int, twins: np.ndarray | None = None) -> list[dict]:
    """Rows for the documents of places; twins: other places with the same window."""
    if not len(d):
        return []
    to = _deal(d, k, ranges)
    order = np.lexsort((p, k, d, to))
    to, d, k, p = to[order], d[order], k[order], p[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    out = [_entry(PLACES if twins is None else TWINS, int(to[a]), None, None, d[a:b], k[a:b], p[a:b], False) for a, b in zip(starts, [*starts[1:], len(to)], strict=True)]
    if twins is not None:
        for row, a, b in zip(out, starts, [*starts[1:], len(to)], strict=True):
            row["hash"] = pack(twins[order][a:b])
    return out


def _columns(table, *names: str) -> list[np.ndarray]:
    """Concatenated arrays of packed columns: hash, check, doc, key (0 where absent), place, old."""
    docs = [np.empty(0, np.int64), *[unpack(x) for x in table["doc"].to_pylist()]]
    out = []
    for name in names:
        values = [None, *table[name].to_pylist()]
        if name in ("hash", "check"):
            out.append(np.frombuffer(b"".join(values[1:]), np.uint64 if name == "hash" else np.uint32))
        elif name == "doc":
            out.append(np.concatenate(docs))
        elif name == "key":
            out.append(np.concatenate([np.zeros(len(d), np.int64) if v is None else np.frombuffer(v, np.int64) for v, d in zip(values, docs, strict=True)]))
        elif name == "place":
            out.append(np.concatenate([np.zeros(len(d), np.int64) if v is None else unpack(v) for v, d in zip(values, docs, strict=True)]))
        else:
            out.append(np.repeat(np.array(values, bool), [len(d) for d in docs]))
    return out


def window_entries(rows: DataFrame, ranges: int, bits=None) -> DataFrame:
    """Packed entries (ENTRY) of the windows whose anchor passes the filter; rows: doc, key and text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, parts, held = Fingerprints(), [], 0
        for ids, texts in _blocks(batches, ("doc", "key")):
            low, high, which, at, place = prints.of(texts)
            if not len(at):
                continue
            if bits is not None:
                ok = in_filter(bits.value, prints.anchors(low)[at])
                which, at, place = which[ok], at[ok], place[ok]
            if not len(at):
                continue
            h, c = prints.windows(low, high, at)
            d, k = (np.array([i[j] for i in ids], np.int64)[which] for j in (0, 1))
            parts.append((h, c, d, k, place))
            held += len(h)
            if held >= CHUNK:
                yield _settled(parts, ranges)
                parts, held = [], 0
        if parts:
            yield _settled(parts, ranges)

    return rows.mapInArrow(run, ENTRY)


def _merge(ranges: int):
    """Merge of one hash range: the new batch's first places, and the places of its repeats."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        firsts = table.filter(pc.equal(table["kind"], FIRSTS))
        known = table.filter(pc.not_equal(table["kind"], FIRSTS)).to_pylist()
        if not firsts.num_rows:
            return pa.Table.from_pylist(known, _schema())
        (h, c, d, k, p, old), new = _by_window(_columns(firsts, "hash", "check", "doc", "key", "place", "old"))
        least = _least(d, new)
        repeat = ~old & (d > least)
        run = new & (_least(np.where(old, d, LAST), new) > least)  # the run has ids of places that no run before has
        which = int(firsts["range"][0].as_py())
        out = known + _places(d[repeat], k[repeat], p[repeat], ranges)
        if run.any():
            out.append(_entry(FIRSTS, which, h[run], c[run], least[run], None, None, True))
        return pa.Table.from_pylist(out, _schema())

    return run


def _compacted(table):
    """All runs of one hash range as one, with the smallest id of each window."""
    import pyarrow as pa

    (h, c, d), new = _by_window(_columns(table, "hash", "check", "doc"))
    d = _least(d, new)
    return pa.Table.from_pylist([_entry(FIRSTS, int(table["range"][0].as_py()), h[new], c[new], d[new], None, None, True)], _schema())


class FingerprintIndex:
    """Runs of first places, each sorted by hash within its hash ranges and never changed."""

    def __init__(self, ranges: int = 64, most_runs: int = MOST_RUNS):
        self.ranges, self.most_runs, self.runs, self.compactions = ranges, most_runs, [], 0

    def add(self, rows: DataFrame, bits=None) -> DataFrame:
        """Packed places of the repeats of a batch (doc, key, text) whose ids are above all ids before; its first places become a run."""
        if len(self.runs) > self.most_runs:
            self.compact()
        every = window_entries(rows, self.ranges, bits)
        for run in self.runs:
            every = every.unionByName(run)
        judged = stored(every.groupBy("range").applyInArrow(_merge(self.ranges), ENTRY), "window_run", ["kind"])
        run = judged.where(F.col("kind") == FIRSTS)
        run._stored_at = f"{judged._stored_at}/kind={FIRSTS}"
        self.runs.append(run)
        return judged.where(F.col("kind") != FIRSTS)

    def compact(self) -> None:
        """Merge all runs into one."""
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        merged = stored(every.groupBy("range").applyInArrow(_compacted, ENTRY), "compacted_run")
        discard(*self.runs)
        self.runs, self.compactions = [merged], self.compactions + 1


def removals(places: DataFrame) -> DataFrame:
    """doc, key, starts and ends: the spans of words to remove from each document, from packed places."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(table: pa.Table) -> pa.Table:
        twins = table.filter(pc.equal(table["kind"], TWINS))
        d, k, p = _columns(table.filter(pc.equal(table["kind"], PLACES)), "doc", "key", "place")
        if twins.num_rows:
            td, tk, tp = _columns(twins, "doc", "key", "place")
            other = np.concatenate([unpack(x) for x in twins["hash"].to_pylist()])
            every = [np.concatenate(x) for x in ((d, td), (k, tk), (p, tp))]
            order = np.lexsort(every[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in every], axis=0)
            gone = np.logical_or.reduceat(order < len(d), np.flatnonzero(new))[np.cumsum(new) - 1]
            also = order[gone & (order >= len(d))] - len(d)
            d, k, p = np.concatenate([d, td[also]]), np.concatenate([k, tk[also]]), np.concatenate([p, other[also]])
        order = np.lexsort((p, k, d))
        d, k, p = d[order], k[order], p[order]
        if not len(d):
            return pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]).empty_table()
        document = np.ones(len(d), bool)
        document[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        span = document.copy()
        span[1:] |= p[1:] > p[:-1] + WINDOW
        starts, ends = p[span], p[np.r_[np.flatnonzero(span)[1:] - 1, len(p) - 1]] + WINDOW
        at = np.flatnonzero(document[span])
        cuts = np.append(at, len(starts))
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64())) for x in (starts, ends)]
        return pa.Table.from_arrays([pa.array(d[document]), pa.array(k[document]), *lists], ["doc", "key", "starts", "ends"])

    return places.groupBy("range").applyInArrow(run, "doc long, key long, starts array<long>, ends array<long>")


def _strip(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        counts, removed, kept = [], [], []
        starts, ends = batch.column("starts"), batch.column("ends")
        for i, text in enumerate(batch.column("text")):
            words = text.as_py().split()
            counts.append(len(words))
            if starts[i].is_valid:
                spans = list(zip(starts[i].as_py(), ends[i].as_py(), strict=True))
                removed.append(sum(b - a for a, b in spans))
                words = [w for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(words)], strict=True) for w in words[a:b]]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def strip_repeats(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row (doc, key, text).

    spans: as from removals(). A filter of the documents with a repeat, which passes a few others, decides which texts are dealt.
    """
    address = F.xxhash64("doc", "key")
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(spans.select(address.alias("h")), "h", MOST_DOC_BITS))
    marked = rows.withColumn("h", address)

    def having(repeats: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(in_filter(bits.value, batch.column("h").to_numpy().view(np.uint64)) == repeats)

        return marked.mapInArrow(run, "doc long, text binary, key long, h long")

    none = F.lit(None).cast("array<long>")
    clean = having(False).select("doc", "text", none.alias("starts"), none.alias("ends"))
    dealt = having(True).join(spans, ["doc", "key"], "left").select("doc", "text", "starts", "ends")
    stripped = [part.withColumn("doc_id", F.when(F.col("doc") != LAST, F.col("doc"))).select("doc_id", "text", "starts", "ends") for part in (clean, dealt)]
    clean, dealt = (part.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept string") for part in stripped)
    return clean.unionByName(dealt)


def substring_dedup(docs: DataFrame, cuts: tuple[float, ...] = CUTS, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept for each row; documents come in batches of ascending ids, cut at shares of them.

    A null text has no words; an empty table gives an empty result. Rows that share an id are one document where
    documents are compared, and each is stripped by itself. A row without id counts as larger than all ids and takes
    away nothing from others without id. Extra columns are never read. index: runs of earlier batches, with smaller ids, whose
    windows were all entered; the anchor filter, which knows these documents only, is then left out.
    """
    rows, digest = _rows(docs), F.xxhash64("text")
    each = rows.withColumn("x", digest).groupBy("doc").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.sum(F.octet_length("text")).alias("size"))
    edges = F.percentile_approx("doc", F.array(*[F.lit(float(c)) for c in (cuts or (1.0,))]), 1000).alias("edges")
    several = F.max((F.col("doc") != LAST) & (F.col("a") != F.col("b"))).alias("several")
    known = each.agg(F.sum("size").alias("size"), edges, several).first()
    # Places belong to a text. A text of an id that has several of them, or of no id, is told from the others by its hash.
    rows = rows.withColumn("key", F.when(F.col("doc") == LAST, digest.bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    if known.several:
        shared = each.where((F.col("doc") != LAST) & (F.col("a") != F.col("b"))).select("doc", F.lit(True).alias("several"))
        rows = rows.join(shared, "doc", "left").withColumn("key", F.when(F.col("several"), digest.bitwiseOR(F.lit(1))).otherwise(F.col("key"))).drop("several")
    rows = rows.select("doc", "text", "key")
    bits = None
    if index is None:
        index = FingerprintIndex(1 << max(4, min(16, ((known.size or 0) // RANGE_BYTES).bit_length())))
        anchors = stored(shared_anchors(rows.select("doc", "text"), index.ranges), "anchors")
        bits = docs.sparkSession.sparkContext.broadcast(bit_filter(anchors, "hashes", MOST_FILTER_BITS))
        discard(anchors)
    low, places, written = None, None, []
    for high in sorted({e for e in (known.edges or ()) if cuts and e != LAST}) + [LAST]:
        part = rows.where((F.col("doc") <= high) & (F.col("doc") > low) if low is not None else F.col("doc") <= high)
        written.append(index.add(part, bits))
        places = written[-1] if places is None else places.unionByName(written[-1])
        low = high
    spans = stored(removals(places), "removals")
    release(docs.sparkSession)
    return strip_repeats(rows, spans)
