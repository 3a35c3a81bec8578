"""Byte-level byte-pair encoding and decoding, exact and in linear time.

A text is cut into pieces by a pattern, and each piece is encoded by itself. A piece's bytes are mapped to Latin-1
characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token at each position in one pass.
The encoder takes longest tokens from the left. A token may follow another only if the pair is *compatible*, that is if
merging the two tokens' joint bytes by rank gives just these two; else it tries the next shorter prefix token, and with
none left it steps back and marks the position as dead, so no position is given up twice. Since an encoding is
right if and only if all neighbouring tokens are compatible, the result equals that of merging by rank. Compatibility of
a pair is decided by undoing merges, and memoised. A piece that is itself a token is that token, merges or not.

Workers build the tables once for each vocabulary file and keep a bounded memo of pieces and pairs.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries of a worker's memo of pieces, and of pairs; a full memo is emptied.
PIECES, PAIRS = 300_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = [len(x) for x in self.bytes_of]
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.shorter = [-1] * size
        reachable = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    continue  # no sequence of merges gives it; it stands only for a whole piece
                self.halves[rank] = parts
                self.joined[parts] = rank
            reachable.add(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        for token in reachable:
            cut = len(token) - 1
            while cut and token[:cut] not in reachable:
                cut -= 1
            if cut:
                self.shorter[ranks[token]] = ranks[token[:cut]]
        self.automaton.make_automaton()
        self.pair_memo: dict[int, bool] = {}
        self.piece_memo: dict[str, tuple[int, ...]] = {}

    def _merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """The token's bytes merged by ranks under its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(self.ranks[p] for p in parts)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens leaves exactly the two."""
        key = left << 32 | right
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) >= PAIRS:
                self.pair_memo.clear()
            known = self.pair_memo[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Merges are undone from the latest to the earliest, on whichever side has it. If the parts that then touch could
        # merge before the merge that was undone last, the boundary would not have lasted.
        before = len(self.bytes_of)
        while True:
            over = self.joined.get((left, right))
            if over is not None and over < before:
                return False
            from_left, from_right = self.halves[left], self.halves[right]
            if from_left and (left > right or not from_right):
                # A merge on the left that is undone happened strictly before a tie on the right.
                if not from_right and left < right and right >= before:
                    return True
                before, left = left, from_left[1]
            elif from_right:
                before, right = right + 1, from_right[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, lengths, shorter, compatible = len(piece), self.lengths, self.shorter, self.compatible
        longest = [0] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str, into: array) -> None:
        memo = self.piece_memo
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(memo) >= PIECES:
                        memo.clear()
                    memo[piece] = ids
            into.extend(ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``tokens`` (array of int) for each row of docs; a null or empty text has no tokens.

    Special tokens are never made: their strings are ordinary text. Texts are taken whole. Rows, repeated or not, are
    encoded one by one; an empty table gives an empty one. path: a vocabulary file of base64 bytes and ranks that every
    executor has, its ranks in order of merging and with all single bytes.
    """
    import pyarrow as pa

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch.column("__text").to_pylist():
                bpe.encode(text, flat)
                offsets.append(len(flat))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], tokens], [*keep, "tokens"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``decoded`` (binary) for each row with ``tokens``; null or empty tokens give no bytes."""
    import pyarrow as pa

    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], "tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "tokens") + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            column = batch.column("tokens")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = [bpe.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.binary())], [*keep, "decoded"])

    return rows.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256: texts encoded, and the ids decoded again.

    The ids stay beside the decoded bytes, so no join is needed. The digests are stored, so that texts come in small batches.
    """
    encoded = encode(docs, path, pattern, keep)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    kept = [F.col(f"`{c}`") for c in keep]
    encoded = encoded.select(*kept, F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "tokens")
    both = decode(encoded, path, pattern, keep=(*keep, "n_tokens", "ids_sha256"))
    return stored(both.select(*kept, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")), "digests")
