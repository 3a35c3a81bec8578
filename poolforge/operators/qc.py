"""Quality flags, round-to-round consistency and readiness checks of counted pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import canonical_kmers
from . import counts as C
from . import profiles as P

# Thresholds of the checks.
RAREFY_DEPTH, LOW_MATCH, MAX_MODES, REVERSE_SHARE, LOW_READS, ADAPTER_SHARE = 10_000, 0.4, 2, 0.20, 10_000, 0.05
ALPHABET_FAIL, ALPHABET_WARN = 0.005, 0.001
LENGTH_SLACK, MODE_SHARE, MODE_SHARE_RELAXED, SHORT_SHARE = 2, 0.60, 0.30, 0.005
RESIDUE, TRUSEQ_READS, PREFIX = 0.02, 0.01, 15
TOP_BASE, TOP_BASE_DOPED, MIN_ENTROPY, EDGE = 0.50, 0.90, 1.7, 10
LOW_ENTROPY, TOP_KMER = 1.5, 0.10
MIN_LOG2FC, MIN_SEQS, RATIO_RISE = 2.0, 100, 1.10
RELAXED = ("variable_length_undoped", "no_r0_post_selection", "doped_3pct", "doped_8pct", "multiplexed_origin")
UNDOPED = ("undoped", "standard", "variable_length_undoped", "multiplexed_origin", "aptasim_excluded")
DOPED = ("doped_3pct", "doped_8pct")


def diversity_rises(counts: DataFrame, depth: int = RAREFY_DEPTH) -> DataFrame:
    """Unique sequences of each round at equal depth, the round before, and whether they rise.

    depth: at most; less if the smallest round has fewer reads.
    """
    smallest = C.round_totals(counts).agg(F.min("total")).first()[0] or 0
    at = min(depth, smallest)
    if not at:
        return C.round_totals(counts).select("round", F.lit(0).cast("long").alias("uniques"), F.lit(None).cast("long").alias("before"), F.lit(False).alias("rises"))
    uniques = C.rarefied(counts, at).groupBy("round").agg(F.count(F.lit(1)).alias("uniques"))
    before = F.lag("uniques").over(Window.orderBy("round"))
    return uniques.withColumn("before", before).withColumn("rises", F.coalesce(F.col("uniques") > F.col("before"), F.lit(False)))


def low_match(report: DataFrame) -> Column:
    return (F.col("match_rate_5p") < LOW_MATCH) | (F.col("match_rate_3p") < LOW_MATCH)


def length_variation(counts: DataFrame) -> DataFrame:
    """Number of different modal lengths over the rounds, and whether they are too many."""
    return C.modal_length(counts).agg(F.count_distinct("modal_length").alias("n_modes")).withColumn("flag", F.col("n_modes") > MAX_MODES)


def strand_mix(strands: DataFrame) -> DataFrame:
    """Rounds whose reverse share, of all reads, is too large."""
    total = F.col("forward") + F.col("reverse") + F.col("ambiguous")
    return strands.select("round", F.try_divide("reverse", total).alias("reverse_share")).withColumn("flag", F.coalesce(F.col("reverse_share") > REVERSE_SHARE, F.lit(False)))


def low_reads(counts: DataFrame, least: int = LOW_READS) -> DataFrame:
    return C.round_totals(counts).withColumn("flag", F.col("total") < least)


def adapter_contamination(hits: DataFrame, reads_in: DataFrame, share: float = ADAPTER_SHARE) -> DataFrame:
    """Adapter hits against the reads that went into trimming of the earliest round; no reads give severity info.

    hits: round, adapter, hits. reads_in: round, n_in.
    """
    first = reads_in.agg(F.min("round").alias("round"), F.min_by("n_in", "round").alias("n_in"))
    by = hits.join(F.broadcast(first), "round").select("round", "adapter", F.try_divide("hits", "n_in").alias("share"))
    return by.withColumn("severity", F.when(F.col("share").isNull(), "info").when(F.col("share") > share, "warning").otherwise("none"))


def mode_changed(manifests: DataFrame) -> DataFrame:
    """Datasets whose manifests name more than one extraction mode (dataset, extraction_mode)."""
    by = manifests.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("extraction_mode").alias("n_modes"))
    return by.withColumn("flag", (F.col("n") >= 2) & (F.col("n_modes") > 1))


def flags(counts: DataFrame, report: DataFrame, strands: DataFrame, hits: DataFrame, reads_in: DataFrame) -> DataFrame:
    """name and severity of the flags that fire, sorted by name."""
    one = lambda df, name: df.agg(F.bool_or("flag").alias("on")).where("on").select(F.lit(name).alias("name"), F.lit("warning").alias("severity"))
    out = one(diversity_rises(counts).withColumn("flag", F.col("rises")), "rarefied_diversity_increase")
    out = out.unionByName(one(report.select(low_match(report).alias("flag")), "low_primer_match"))
    out = out.unionByName(one(length_variation(counts), "n_length_variation")).unionByName(one(strand_mix(strands), "strand_mix"))
    out = out.unionByName(one(low_reads(counts), "low_total_reads"))
    contaminated = adapter_contamination(hits, reads_in).agg(F.max(F.when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 1).otherwise(0)).alias("level"))
    out = out.unionByName(contaminated.where("level > 0").select(F.lit("adapter_contamination").alias("name"), F.when(F.col("level") == 2, "warning").otherwise("info").alias("severity")))
    merging = report.select((F.col("required_action") == "READ_MERGING_RECOMMENDED").alias("flag"))
    return out.unionByName(one(merging, "needs_read_merging")).orderBy("name")


def kmer_sets(counts: DataFrame, k: int = 6, n: int = 10_000) -> DataFrame:
    """Distinct canonical k-mers of the n most frequent sequences of each round."""
    return C.top(counts, n).select("round", F.explode(canonical_kmers(F.col("seq"), k)).alias("kmer")).distinct()


def jaccard_distances(sets: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """a, b and distance of every pair of rounds a < b; two empty sets have distance 0, disjoint ones 1.

    Shared k-mers come from one equi-join by k-mer; pairs of rounds are few.
    """
    sizes = sets.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    if rounds is not None:
        sizes = rounds.select("round").distinct().join(sizes, "round", "left").na.fill(0, ["n"])
    a, b = sizes.select(F.col("round").alias("a"), F.col("n").alias("na")), sizes.select(F.col("round").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    x, y = sets.select(F.col("round").alias("a"), "kmer"), sets.select(F.col("round").alias("b"), "kmer")
    both = x.join(y, "kmer").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    shared = F.coalesce("both", F.lit(0).cast("long"))
    union = F.col("na") + F.col("nb") - shared
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.when(union == 0, 0.0).otherwise(1 - shared / union).alias("distance"))


def monotone(distances: DataFrame, slack: float = 0.10) -> DataFrame:
    """Whether every round is at most slack nearer to rounds after the next than to the next one; needs three rounds."""
    rounds = distances.select(F.explode(F.array("a", "b")).alias("round")).distinct()
    placed = rounds.withColumn("i", F.row_number().over(Window.orderBy("round")))
    d = distances.join(F.broadcast(placed.select(F.col("round").alias("a"), F.col("i").alias("ia"))), "a")
    d = d.join(F.broadcast(placed.select(F.col("round").alias("b"), F.col("i").alias("ib"))), "b")
    near = d.where("ib = ia + 1").select("ia", F.col("distance").alias("near"))
    triples = d.where("ib >= ia + 2").join(F.broadcast(near), "ia")
    broken = F.count_if(F.col("distance") < F.col("near") * (1 - slack))
    return triples.agg(F.count(F.lit(1)).alias("n_triples"), broken.alias("n_broken")).withColumn("monotone", F.when(F.col("n_triples") > 0, F.col("n_broken") == 0))


def graded(bad: Column, warn: Column, info: Column | None = None) -> Column:
    out = F.when(bad, "FAIL").when(warn, "WARN")
    return (out.when(info, "INFO") if info is not None else out).otherwise("PASS")


def alphabet_check(counts: DataFrame) -> DataFrame:
    x = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq").rlike("[^ACGT]")).alias("bad"))
    share = F.try_divide("bad", "n")
    return x.select(F.lit("alphabet").alias("section"), F.when(F.col("n") == 0, "FAIL").otherwise(graded(share > ALPHABET_FAIL, share > ALPHABET_WARN, F.col("bad") > 0)).alias("status"))


def lengths_check(counts: DataFrame, expected: int, tag: str = "standard") -> DataFrame:
    """Modes near the expected length, an earliest round that mostly has its mode, no short outliers, modes that agree."""
    top5 = C.length_distribution(counts)
    first = counts.agg(F.min("round")).first()[0]
    least = MODE_SHARE_RELAXED if tag in RELAXED else MODE_SHARE
    mode = top5.where("place = 1")
    off = F.bool_or(F.abs(F.col("len") - expected) > LENGTH_SLACK)
    thin = F.bool_or((F.col("round") == F.lit(first)) & (F.col("share") < least))
    spread = F.max("len") - F.min("len") > LENGTH_SLACK
    modes = mode.agg((off | thin | spread).alias("bad"))
    short = top5.agg(F.coalesce(F.bool_or((F.lit(expected * 0.5) > F.col("len")) & (F.col("share") > SHORT_SHARE)), F.lit(False)).alias("short"))
    return modes.join(F.broadcast(short)).select(F.lit("lengths").alias("section"), F.when(F.col("bad") | (F.col("short") & F.lit(bool(expected))), "WARN").otherwise("PASS").alias("status"))


def residue_shares(counts: DataFrame, five: str, three: str) -> DataFrame:
    """Shares of unique sequences that start with the 5' primer's first bases, or end with the 3' primer's."""
    share = lambda c: F.avg(c.cast("double"))
    starts = F.col("seq").startswith(five[:PREFIX]) if five else F.lit(False)
    ends = F.col("seq").endswith(three[:PREFIX]) if three else F.lit(False)
    return counts.groupBy("round").agg(share(starts).alias("starts_5p"), share(ends).alias("ends_3p"))


def trim_check(counts: DataFrame, five: str, three: str) -> DataFrame:
    residue = residue_shares(counts, five, three).agg(F.max("starts_5p").alias("a"), F.max("ends_3p").alias("b"))
    truseq = P.contamination(counts).agg(F.max("read_share").alias("c"))
    bad = (F.col("a") > RESIDUE) | (F.col("b") > RESIDUE) | (F.col("c") > TRUSEQ_READS)
    return residue.join(F.broadcast(truseq)).select(F.lit("trim_seq").alias("section"), F.when(bad, "FAIL").otherwise("PASS").alias("status"))


def _earliest_mode(counts: DataFrame) -> DataFrame:
    """Unique sequences of the earliest round that have its commonest length."""
    first = counts.join(F.broadcast(counts.agg(F.min("round").alias("round"))), "round")
    mode = C.length_distribution(first, 1).select("len")
    return first.join(F.broadcast(mode), F.length("seq") == F.col("len")).drop("len")


def _edges(mode_seqs: DataFrame) -> DataFrame:
    """side, pos, top and bits of the first and last positions, over unique sequences."""
    one = F.lit(1).cast("long")
    sides = [P.positional_entropy(P.base_counts(mode_seqs, EDGE, side, weight=one)).withColumn("side", F.lit("tail" if side else "head")) for side in (False, True)]
    return sides[0].unionByName(sides[1])


def composition_check(counts: DataFrame, tag: str = "standard") -> DataFrame:
    """Edges without a dominant base (or enough entropy in spite of it), and a usual GC share."""
    seqs = _earliest_mode(counts)
    if tag == "no_r0_post_selection":
        best = seqs.orderBy(F.desc("reads"), F.desc("seq")).limit(5)
        prefixes = best.where(F.length("seq") >= 6).agg(F.count_distinct(F.substring("seq", 1, 6)).alias("n"))
        return prefixes.select(F.lit("composition").alias("section"), F.when(F.col("n") >= 3, "PASS").otherwise("WARN").alias("status"))
    limit = TOP_BASE_DOPED if tag in DOPED else TOP_BASE
    edges = _edges(seqs).agg(F.coalesce(F.max("top") > limit, F.lit(False)).alias("over"), F.avg("bits").alias("bits"))
    gc = P.gc_stats(seqs).select("gc_mean")
    varied = (F.col("bits") >= MIN_ENTROPY) if tag not in DOPED else F.lit(False)
    odd = (F.col("gc_mean") < 0.25) | (F.col("gc_mean") > 0.75)
    call = F.when(F.col("over") & varied, "WARN").when(F.col("over"), "FAIL").when(odd, "WARN").otherwise("PASS")
    return edges.join(F.broadcast(gc)).select(F.lit("composition").alias("section"), call.alias("status"))


def diversity_check(counts: DataFrame, tag: str = "standard") -> DataFrame:
    """Edges with enough entropy and no dominant 6-mer, in undoped pools."""
    first = counts.join(F.broadcast(counts.agg(F.min("round").alias("round"))), "round")
    bits = _edges(_earliest_mode(counts)).groupBy("side").agg(F.avg("bits").alias("bits")).agg(F.min("bits").alias("bits"))
    kmer = P.top_kmers(first, 6, 1).select(F.col("share").alias("kmer_share"))
    bad = ((F.col("bits") < LOW_ENTROPY) | (F.col("kmer_share") > TOP_KMER)) if tag in UNDOPED else F.lit(False)
    return bits.join(F.broadcast(kmer)).select(F.lit("diversity").alias("section"), F.when(bad, "WARN").otherwise("PASS").alias("status"))


def enrichment(counts: DataFrame, first: int, last: int) -> DataFrame:
    """sequence and log2 fold change of reads per million between two rounds, with half a read for absence."""
    x = C.with_totals(counts.where(F.col("round").isin(first, last)))
    by = x.groupBy("seq").agg(*[F.max(F.when(F.col("round") == r, F.col("reads"))).alias(f"n{i}") for i, r in enumerate((first, last))])
    total = C.round_totals(counts).agg(*[F.max(F.when(F.col("round") == r, F.col("total"))).alias(f"t{i}") for i, r in enumerate((first, last))])
    share = lambda i: F.coalesce(f"n{i}", F.lit(0.5)) / F.col(f"t{i}")
    return by.join(F.broadcast(total)).select("seq", F.round(F.log2(share(1) / share(0)), 9).alias("log2fc"))


def selection_check(changes: DataFrame) -> DataFrame:
    """Enough sequences, and one at least that is clearly enriched."""
    x = changes.agg(F.count(F.lit(1)).alias("n"), F.max("log2fc").alias("top"), F.avg((F.col("log2fc") > 0).cast("double")).alias("positive"))
    call = F.when(F.col("n") == 0, "FAIL").when((F.col("top") < MIN_LOG2FC) | (F.col("n") < MIN_SEQS), "WARN").otherwise("PASS")
    return x.select(F.lit("selection").alias("section"), call.alias("status"))


def top_traced(counts: DataFrame, n: int = 5) -> DataFrame:
    """How many of the last round's most frequent sequences stand in the first round."""
    ends = counts.agg(F.min("round").alias("first"), F.max("round").alias("last"))
    marked = counts.join(F.broadcast(ends), F.col("round").between(F.col("first"), F.col("last")))
    best = marked.where("round = last").orderBy(F.desc("reads"), F.desc("seq")).limit(n)
    return best.join(marked.where("round = first").select("seq"), "seq", "left_semi").agg(F.count(F.lit(1)).alias("n_traced"))


def unique_ratio_check(counts: DataFrame) -> DataFrame:
    """Unique sequences for each read, which must not rise by over a tenth from the first to the last of three or more rounds."""
    by = counts.groupBy("round").agg((F.count(F.lit(1)) / F.sum("reads")).alias("ratio"))
    ends = by.agg(F.count(F.lit(1)).alias("n"), F.min_by("ratio", "round").alias("first"), F.max_by("ratio", "round").alias("last"))
    return ends.select(F.lit("consistency").alias("section"), F.when((F.col("n") >= 3) & (F.col("last") > F.col("first") * RATIO_RISE), "WARN").otherwise("PASS").alias("status"))


def primer_drift(seed_five: Column, seed_three: Column, five: Column, three: Column) -> Column:
    """INFO without any summary primer, WARN where a summary primer differs from the seed's, else PASS."""
    differs = lambda seen, seed: F.coalesce((seen != "") & (seen != seed), F.lit(False))
    return F.when(five.isNull() & three.isNull(), "INFO").when(differs(five, seed_five) | differs(three, seed_three), "WARN").otherwise("PASS")


def pre_check(counts: DataFrame) -> DataFrame:
    """Whether there are counts at all, with their totals."""
    x = counts.agg(F.count_distinct("round").alias("n_rounds"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("reads"), F.lit(0)).alias("n_reads"))
    return x.select(F.lit("pre").alias("section"), F.when(F.col("n_rounds") == 0, "FAIL").otherwise("PASS").alias("status"))


def worst(checks: DataFrame) -> DataFrame:
    """FAIL over WARN over PASS; INFO does not count."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    level = F.coalesce(F.max(rank), F.lit(0))
    return checks.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), level + 1).alias("worst"))


def readiness(counts: DataFrame, expected: int, five: str, three: str, tag: str = "standard") -> DataFrame:
    """section and status of all checks of a pool."""
    last = counts.agg(F.min("round"), F.max("round")).first()
    parts = [
        pre_check(counts),
        alphabet_check(counts),
        lengths_check(counts, expected, tag),
        trim_check(counts, five, three),
        composition_check(counts, tag),
        diversity_check(counts, tag),
        selection_check(enrichment(counts, last[0], last[1])),
        unique_ratio_check(counts),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
