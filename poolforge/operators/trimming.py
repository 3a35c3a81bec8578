"""Cutting constants from reads: a native strict path, an aligner that allows gaps, orientation and demultiplexing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import near_prefix, reverse_complement

ERROR_RATE, MIN_OVERLAP, MIN_LENGTH, MAX_LENGTH = 0.1, 3, 15, 200


def _with_substitutions(word: str, k: int) -> str:
    """Pattern of all words within k substitutions of word.

    Of k + 1 pieces of such a word one at least stands as it is; it is looked for ahead, before the variants of the others.
    """
    k = min(k, len(word))
    if not k:
        return word

    def variants(part: str) -> list[str]:
        return ["".join("." if i in gone else c for i, c in enumerate(part)) for gone in map(set, combinations(range(len(part)), min(k, len(part))))]

    cuts = [len(word) * i // (k + 1) for i in range(k + 2)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece, rest = word[a:b], word[:a] + word[b:]
        some = "|".join(v[:a] + piece + v[a:] for v in variants(rest))
        out.append(f"(?=.{{{a}}}{piece})(?:{some})")
    return "|".join(out)


def _three_start(seq: Column, primer: str, rate: float) -> Column:
    """Start of the 3' primer with allowed substitutions, whole or cut off at the read's end; -1 for none.

    The place with most equal letters wins, then the one with fewest errors, then the leftmost. Up to two substitutions are
    generated patterns, tried from the best outcome down, so that a read is searched no further than its best match.
    """
    size, n = len(primer), F.length(seq)
    if int(rate * size) <= 2:
        tries = [(-(size - k), k, F.nullif(F.regexp_instr(seq, F.lit(_with_substitutions(primer, k))), F.lit(0)) - 1) for k in range(int(rate * size) + 1)]
        for cut in range(MIN_OVERLAP, size):
            tail = F.right(seq, F.lit(cut))
            for k in range(int(rate * cut) + 1):
                here = seq.endswith(primer[:cut]) if not k else (n >= cut) & tail.rlike(f"^(?:{_with_substitutions(primer[:cut], k)})$")
                tries.append((-(cut - k), k, F.when(here, n - cut)))
        return F.coalesce(*[at for _, _, at in sorted(tries, key=lambda t: t[:2])], F.lit(-1))

    def at(i: Column) -> Column:
        reach = F.least(F.lit(size), n - i)
        differ = F.aggregate(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), F.lit(0), lambda acc, j: acc + F.when(F.substring(seq, i + j, F.lit(1)) == F.substring(F.lit(primer), j, F.lit(1)), 0).otherwise(1))
        return F.struct((differ - reach).alias("unequal"), differ.alias("errors"), i.alias("start"), ((reach >= MIN_OVERLAP) & (differ <= F.floor(reach * rate))).alias("good"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at), lambda x: x["good"])
    return F.coalesce(F.array_min(found)["start"], F.lit(-1))


def strict_trim(reads: DataFrame, five: str | None, three: str | None, rate: float = ERROR_RATE, shortest: int = MIN_LENGTH, longest: int | None = MAX_LENGTH) -> DataFrame:
    """reads whose insert lies between an anchored 5' primer and a 3' primer, without gaps; seq becomes the insert.

    Columns only, so the plan stays in generated code. What a step finds goes through a generator: a filter on it would be pushed
    below the projection, and the whole search with it, and run twice.
    """
    rest = [F.col(f"`{c}`") for c in reads.columns if c != "seq"]
    out, seq = reads, F.col("seq")
    if five:
        head = seq.rlike(f"^(?:{_with_substitutions(five, int(rate * len(five)))})")
        out = out.select(*rest, F.explode(F.when(head, F.array(F.substring(seq, F.lit(len(five) + 1), F.length(seq))))).alias("seq"))
    if three:
        out = out.select(*rest, seq, F.explode(F.array(_three_start(seq, three, rate))).alias("__at")).where("__at >= 0")
        out = out.select(*rest, F.substring(seq, F.lit(1), F.col("__at")).alias("seq"))
    out = out.select(*[F.col(f"`{c}`") for c in reads.columns]).where(F.length("seq") >= shortest)
    return out.where(F.length("seq") <= longest) if longest is not None and three else out


# What each ambiguity code stands for.
_CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


class Aligner:
    """Semi-global alignment of a primer within a read at unit costs; ambiguity codes of the primer match what they stand for.

    The match with most equal letters wins, then the leftmost. Errors are limited to a share of the aligned primer letters.
    """

    def __init__(self, primer: str, rate: float = ERROR_RATE, overlap: int = MIN_OVERLAP):
        self.sets = [_CODES.get(c, c) for c in primer.upper()]
        self.plain = primer.upper() if set(primer.upper()) <= set("ACGT") else None
        self.rate, self.overlap, self.memo = rate, overlap, {}

    def find(self, read: str, cut_start: bool = False, cut_end: bool = False) -> tuple[int, int] | None:
        """(start, end) of the primer in read. cut_start, cut_end: its first or last letters may lie outside the read."""
        if self.plain:
            at = read.find(self.plain)
            if at >= 0:
                return at, at + len(self.plain)
        key = (read, cut_start, cut_end)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = self._align(read.upper().replace("U", "T"), cut_start, cut_end)
        return self.memo[key]

    def _align(self, read: str, cut_start: bool, cut_end: bool) -> tuple[int, int] | None:
        m = len(self.sets)
        # A cell holds (errors, -equal letters, start in read, letters of the primer left out at its start).
        column = [(0, 0, 0, i) if cut_start or not i else (i, 0, 0, 0) for i in range(m + 1)]
        best = None

        def offer(cell, used: int, end: int) -> None:
            nonlocal best
            errors, equal, start, skipped = cell
            length = used - skipped
            if length >= self.overlap and errors <= int(self.rate * length):
                rank = (equal, errors, start)
                if best is None or rank < best[0]:
                    best = (rank, start, end)

        for j, letter in enumerate(read, 1):
            new = [(0, 0, j, 0)]
            for i in range(1, m + 1):
                e, q, s, k = column[i - 1]
                hit = letter in self.sets[i - 1]
                diagonal = (e + (not hit), q - hit, s, k)
                e, q, s, k = column[i]
                gap = (e + 1, q, s, k)
                e, q, s, k = new[i - 1]
                new.append(min(diagonal, gap, (e + 1, q, s, k)))
            column = new
            offer(column[m], m, j)
        if cut_end:
            for i in range(1, m):
                offer(column[i], i, len(read))
        return (best[1], best[2]) if best else None


def linked_trim(reads: DataFrame, five: str | None = None, three: str | None = None, rate: float = ERROR_RATE) -> DataFrame:
    """reads with the text between the primers as seq, gaps allowed; reads without every primer given are dropped.

    A lone 5' primer keeps the rest of the read, a lone 3' primer the text before it. reads: any columns with seq.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    place = reads.columns.index("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, back = (Aligner(five, rate) if five else None), (Aligner(three, rate) if three else None)
        for batch in batches:
            out: list[str | None] = []
            for read in batch.column(place).to_pylist():
                begin, end = 0, len(read or "")
                if read is None:
                    out.append(None)
                    continue
                if front:
                    hit = front.find(read, cut_start=True)
                    begin = hit[1] if hit else -1
                if begin >= 0 and back:
                    hit = back.find(read[begin:], cut_end=True)
                    end = begin + hit[0] if hit else -1
                out.append(read[begin:end] if begin >= 0 and end >= 0 else None)
            column = pa.array(out, pa.string())
            yield batch.set_column(place, "seq", column).filter(pc.is_valid(column))

    return reads.mapInArrow(run, reads.schema)


def paired_trim(pairs: DataFrame, five: str, five_of_mate: str) -> DataFrame:
    """Pairs (seq, mate_seq) that have both primers, with the rest of both reads."""
    first = linked_trim(pairs, five=five)
    turned = first.withColumnRenamed("seq", "__seq").withColumnRenamed("mate_seq", "seq")
    return linked_trim(turned, five=five_of_mate).withColumnRenamed("seq", "mate_seq").withColumnRenamed("__seq", "seq").select(*pairs.columns)


def reoriented(reads: DataFrame) -> DataFrame:
    """Reverse complements of the reads, with their qualities turned."""
    out = reads.withColumn("seq", reverse_complement(F.col("seq")))
    return out.withColumn("qual", F.reverse("qual")) if "qual" in reads.columns else out


def check_barcodes(barcodes: list[str], mismatches: int = 1) -> None:
    """Barcodes must be equally long, and far enough apart that no read fits two."""
    if len({len(b) for b in barcodes}) > 1:
        raise ValueError("barcodes differ in length")
    for i, a in enumerate(barcodes):
        for b in barcodes[i + 1 :]:
            if sum(x != y for x, y in zip(a, b, strict=True)) < 2 * mismatches + 1:
                raise ValueError(f"barcodes {a} and {b} are too close")


def demultiplexed(reads: DataFrame, barcodes: list[tuple[str, int]]) -> DataFrame:
    """reads with round by the first barcode (one mismatch) that they start with, which is cut off; others have a null round.

    barcodes: (barcode, round) in sheet order; a fixed small list, so it is a chain of conditions in place of a join.
    """
    check_barcodes([b for b, _ in barcodes])
    seq, call, size = F.col("seq"), F.lit(None).cast("int"), len(barcodes[0][0]) if barcodes else 0
    for code, rnd in reversed(barcodes):
        call = F.when(near_prefix(seq, code), F.lit(rnd)).otherwise(call)
    out = reads.withColumn("round", call)
    cut = lambda c: F.when(F.col("round").isNotNull(), F.substring(c, F.lit(size + 1), F.length(c))).otherwise(F.col(c))
    out = out.withColumn("seq", cut("seq"))
    return out.withColumn("qual", cut("qual")) if "qual" in reads.columns else out


def demux_report(demuxed: DataFrame) -> DataFrame:
    by = demuxed.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    total = demuxed.agg(F.count(F.lit(1)).alias("all"))
    return by.join(F.broadcast(total)).select("round", "n", (F.col("n") / F.col("all")).alias("share"))
