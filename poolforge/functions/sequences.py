"""Nucleotide functions as column expressions; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the nucleotide and ambiguity codes, and known adapters.
SYMBOLS = "ACGTUNRYKMSWBVDHacgtunrykmswbvdh"
COMPLEMENTS = "TGCAANYRMKSWVBHDtgcaanyrmkswvbhd"
ADAPTERS = {"TRUSEQ_R1": "AGATCGGAAGAGC", "NEXTERA": "CTGTCTCTTATACACATCT"}
PROBE = 13


def normalised(seq: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(seq), "U", "T")


def reverse_complement(seq: Column) -> Column:
    """Case and foreign symbols are kept; U becomes A."""
    return F.reverse(F.translate(seq, SYMBOLS, COMPLEMENTS))


def primer_reverse_complement(seq: Column) -> Column:
    """In upper case; a symbol that is no nucleotide or ambiguity code is an error."""
    upper = F.upper(seq)
    bad = F.concat(F.lit("not a nucleotide or ambiguity code in "), seq)
    return F.when(upper.rlike("[^ACGTUNRYKMSWBVDH]"), F.raise_error(bad).cast("string")).otherwise(reverse_complement(upper))


def rc(seq: str) -> str:
    return seq.translate(str.maketrans(SYMBOLS, COMPLEMENTS))[::-1]


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    differ = lambda x, y: F.when(x == y, 0).otherwise(1)
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), differ)
    return F.when(n == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x))


def hamming_le1(a: Column, b: Column) -> Column:
    """Equal lengths and at most one place that differs."""
    return (F.length(a) == F.length(b)) & (hamming(a, b) <= 1)


def one_off_pattern(seq: str) -> str:
    """Regular expression of all words within one substitution of seq."""
    return "|".join(seq[:i] + "." + seq[i + 1 :] for i in range(len(seq))) or ""


def near_pattern(seq: str) -> str:
    """The same words for an engine that looks ahead: one half stands as it is, and is tried before the variants of the other."""
    half = len(seq) // 2
    if not half:
        return one_off_pattern(seq)
    left, right = seq[:half], seq[half:]
    return f"{left}(?:{one_off_pattern(right)})|(?=.{{{half}}}{right})(?:{one_off_pattern(left)}){right}"


def contains_one_off(seq: Column, primer: str) -> Column:
    """Whether a window of seq is within one substitution of primer."""
    return seq.rlike(near_pattern(primer))


def near_prefix(seq: Column, primer: str) -> Column:
    return seq.rlike(f"^(?:{near_pattern(primer)})")


def near_suffix(seq: Column, primer: str) -> Column:
    return seq.rlike(f"(?:{near_pattern(primer)})$")


def at_offset(seq: Column, primer: str, offset: int, slack: int = 3, from_end: bool = False) -> Column:
    """Whether primer stands within one substitution at offset, give or take slack, from the start or the end of seq."""
    low, high = max(0, offset - slack), offset + slack
    if from_end:
        return seq.rlike(f"(?:{near_pattern(primer)}).{{{low},{high}}}$")
    return seq.rlike(f"^.{{{low},{high}}}(?:{near_pattern(primer)})")


def starts_with_adapter(seq: Column) -> Column:
    probes = [x[:PROBE] for a in ADAPTERS.values() for x in (a, rc(a))]
    return F.substring(F.upper(seq), 1, PROBE).isin(probes)


def has_adapter(seq: Column, name: str) -> Column:
    """Whether the adapter's first bases, or those of its reverse complement, stand anywhere."""
    a = ADAPTERS[name]
    return F.contains(F.upper(seq), F.lit(a[:PROBE])) | F.contains(F.upper(seq), F.lit(rc(a)[:PROBE]))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none where seq is shorter."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def canonical_kmers(seq: Column, k: int) -> Column:
    return F.array_distinct(F.transform(kmers(seq, k), canonical))


def occurrences(seq: Column, core: str) -> Column:
    """Starts (from 0) of all occurrences of core, overlapping ones too."""
    n = F.length(seq) - len(core) + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(seq, i + 1, F.lit(len(core))) == core)


def gc_fraction(seq: Column) -> Column:
    return F.try_divide(F.length(seq) - F.length(F.translate(seq, "GC", "")), F.length(seq))


def neighbourhood(seq: str, letters: str = "ACGTN") -> list[str]:
    """seq and all words that differ from it in one place."""
    out = {seq}
    for i in range(len(seq)):
        out |= {seq[:i] + c + seq[i + 1 :] for c in letters}
    return sorted(out)


def without_barcode(seq: Column, barcodes: list[str]) -> Column:
    """seq without the longest listed barcode that it starts with."""
    out = seq
    for b in sorted(set(barcodes), key=lambda x: (len(x), x)):
        out = F.when(seq.startswith(b), F.substring(seq, F.lit(len(b) + 1), F.length(seq))).otherwise(out)
    return out
