"""Helpers shared by the corpus operators: table access, shared storage, word rules, let-binding."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf:
        conf = getattr(spark, "_own_shared_dir", None)
        if conf is None:
            conf = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared_")
    return conf.rstrip("/")


#: Rows of one Arrow batch, as one text can be very long.
BATCH_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Bound the rows of an Arrow batch in plans that run inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, in small Arrow batches, and read again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame | None) -> None:
    """Delete tables written by stored() that no later result reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bind(value: Column, body) -> Column:
    """body(v) with value computed once per row, however often body uses v."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return bind(trimmed, lambda t: F.when(F.length(t) > 0, F.split(t, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>")))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def row_key(df: DataFrame) -> Column:
    """A hash of a row's columns, but for maps, which have none; equal rows have equal keys."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


class HashMemo(dict):
    """Hashes of words, computed once; a memo with more than ``most`` entries is emptied between texts."""

    def __init__(self, digest: Callable[[bytes], int], most: int = 400_000):
        super().__init__()
        self.digest, self.most = digest, most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.digest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordTable(dict):
    """Two independent 64-bit hashes of words, computed once; a table with more than ``most`` words is emptied between calls."""

    def __init__(self, most: int = 400_000):
        import xxhash

        super().__init__()
        self.digest, self.most = xxhash.xxh3_128_digest, most
        self.new, self.hashes = bytearray(), np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new += self.digest(word)
        return i

    def arrays(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the words of all texts, one after another."""
        if len(self) > self.most:
            self.clear()
            self.hashes = self.hashes[:0]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.frombuffer(bytes(self.new), np.uint64).reshape(-1, 2)])
            self.new.clear()
        return self.hashes[at, 0], self.hashes[at, 1]


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes: the width of a difference, the least value, and each value's difference from it."""
    if not len(values):
        return b""
    base = int(values.min())
    reach = int(values.max()) - base
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if reach <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + np.int64(base).tobytes() + (values.view(np.uint64) - np.int64(base).view(np.uint64)).astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]
    base = np.frombuffer(data, np.int64, 1, 1).view(np.uint64)[0]
    return (np.frombuffer(data, kind, offset=9).astype(np.uint64) + base).view(np.int64)


#: Least bits of a filter (a logarithm), and bits for each entry.
LEAST_FILTER_BITS, BITS_EACH = 16, 16


def _marks(hashes: np.ndarray) -> np.ndarray:
    """The three bits of an entry in its 64-bit word."""
    out = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12):
        out |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return out


def bit_filter(table: DataFrame, column: str, most_bits: int) -> np.ndarray:
    """Blocked Bloom filter of the 64-bit hashes in a column (longs, or packed ones as binary), as 64-bit words.

    About ``BITS_EACH`` bits an entry, 2 ** most_bits at most: a larger set lets more through and never fewer. Tasks make pieces
    by address, so that the driver only joins them; its memory and the broadcast are bounded by most_bits.
    """
    import pyarrow as pa

    packed = dict(table.dtypes)[column] == "binary"
    n = table.agg(F.sum(F.octet_length(column) / 8) if packed else F.count(column)).first()[0] or 0
    bits = max(LEAST_FILTER_BITS, min(most_bits, (int(n) * BITS_EACH).bit_length()))
    piece = max(0, bits - 20)

    def run(batches):
        whole = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            values = batch.column(column)
            h = np.frombuffer(b"".join(values.to_pylist()), np.uint64) if packed else values.to_numpy().view(np.uint64)
            np.bitwise_or.at(whole, (h >> np.uint64(70 - bits)).astype(np.int64), _marks(h))
        pieces = whole.reshape(1 << piece, -1)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "words"])

    def merge(rows: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()])
        return pa.table({"piece": rows["piece"][:1], "words": pa.array([whole.tobytes()], pa.binary())})

    parts = table.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "piece long, words binary")
    out = np.zeros((1 << piece, 1 << (bits - 6 - piece)), np.uint64)
    for row in parts.groupBy("piece").applyInArrow(merge, "piece long, words binary").toLocalIterator():
        out[row.piece] = np.frombuffer(row.words, np.uint64)
    return out.ravel()


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    marks = _marks(hashes)
    return words[(hashes >> np.uint64(65 - len(words).bit_length())).astype(np.int64)] & marks == marks
