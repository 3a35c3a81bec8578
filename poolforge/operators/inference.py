"""Inference of the constant flanks of a pool, and of how reads can be extracted.

Reads are only met by aggregations (profiles, match rates, core places). What comes to the driver is a row for each
round, side and position up to ``MAX_LEN``, on which the boundary rules run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import ADAPTERS, PROBE, near_prefix, near_suffix, normalised, rc, starts_with_adapter
from . import profiles, signals
from .counts import counted, top, unique_counts

# Calibration constants of the rules below.
MIN_LEN, MAX_LEN, MIN_READS, CONFIDENCE = 14, 60, 500, 0.75
FLOOR, STRONG_SHARE, DROP_RUN = 0.55, 0.80, 2
CLIFF_BASELINE, CLIFF_DROP, CLIFF_AFTER = 0.90, 0.12, 0.85
CORE_SUPPORT, CORE_LEN, CORE_RUN = 0.90, 12, 3
SEARCH_SLACK, MIN_ANCHORED, ANCHOR_AGREEMENT = 12, 0.5, 0.8
FOUND, UNABLE, SHARP_LENGTH, SLACK, VARIANTS = 0.7, 0.4, 0.8, 3, 3
HIGH, MEDIUM, LOW = 0.85, 0.60, 0.30
WEIGHTS = {"match_5p": 0.15, "match_3p": 0.15, "pos_5p": 0.15, "pos_3p": 0.15, "persistence": 0.25, "n_len": 0.10, "adapter_clean": 0.05}
WEIGHTS_ONE_ROUND = {"match_5p": 0.225, "match_3p": 0.225, "pos_5p": 0.225, "pos_3p": 0.225, "persistence": 0.0, "n_len": 0.05, "adapter_clean": 0.05}


def support_flags(consensus: DataFrame, *keys: str) -> DataFrame:
    """consensus (keys, pos, support) with cliff and low, at the positions where a flank may end; keys: ``round`` unless given.

    cliff: after enough positions with a high median support falls sharply and stays down. low: this position and the next
    one lie under the floor.
    """
    order = Window.partitionBy(*(keys or ("round",))).orderBy("pos")
    s = consensus.withColumns({"next": F.lead("support").over(order), "base": F.percentile("support", F.lit(0.5)).over(order.rowsBetween(-MIN_LEN, -1))})
    two = F.greatest("support", "next")
    cliff = F.col("next").isNotNull() & (F.col("pos") >= MIN_LEN) & (F.col("base") >= CLIFF_BASELINE) & (F.col("support") <= F.col("base") - CLIFF_DROP) & (two < CLIFF_AFTER)
    low = F.col("next").isNotNull() & (two < min(CONFIDENCE, FLOOR))
    return s.withColumns({"cliff": F.coalesce(cliff, F.lit(False)), "low": low}).drop("next", "base")


def support_cliffs(consensus: DataFrame) -> DataFrame:
    """round and cliff: the first position whose support falls well below the median of the MIN_LEN positions before it."""
    before = Window.partitionBy("round").orderBy("pos").rowsBetween(-MIN_LEN, -1)
    s = consensus.withColumn("base", F.percentile("support", F.lit(0.5)).over(before))
    falls = (F.col("pos") >= MIN_LEN) & (F.col("base") >= CLIFF_BASELINE) & (F.col("support") <= F.col("base") - CLIFF_DROP)
    return s.where(falls).groupBy("round").agg(F.min("pos").alias("cliff"))


def floor_runs(consensus: DataFrame) -> DataFrame:
    """round and floor_at: the first of two positions in a row whose support lies below the floor."""
    s = consensus.withColumn("next", F.lead("support").over(Window.partitionBy("round").orderBy("pos")))
    return s.where((F.col("support") < FLOOR) & (F.col("next") < FLOOR)).groupBy("round").agg(F.min("pos").alias("floor_at"))


def strong_shares(consensus: DataFrame, length: int) -> DataFrame:
    """round and strong: the share of the first positions with the support of a called flank."""
    return consensus.where(F.col("pos") < length).groupBy("round").agg(F.avg((F.col("support") >= CONFIDENCE).cast("double")).alias("strong"))


def flank_boundaries(consensus: DataFrame, *keys: str) -> DataFrame:
    """keys (``round`` unless given) and boundary: the length of the constant flank that starts a support profile, 0 for none."""
    keys = keys or ("round",)
    flagged = support_flags(consensus, *keys)
    end = F.least(F.min(F.when(F.col("cliff") | F.col("low"), F.col("pos"))), F.count(F.lit(1)))
    strong = F.collect_list(F.when(F.col("support") >= CONFIDENCE, F.col("pos")))
    ends = flagged.groupBy(*keys).agg(end.alias("end"), strong.alias("strong"))
    share = F.size(F.filter("strong", lambda p: p < F.col("end"))) / F.col("end")
    good = (F.col("end") >= MIN_LEN) & (share >= STRONG_SHARE)
    return ends.select(*keys, F.when(good, F.col("end")).otherwise(0).cast("long").alias("boundary"))


def outer_cut(supports: list[float]) -> int:
    """How many outer positions to leave before the deepest weak one that precedes a stable run; 0 if none is weak."""
    cut, run = 0, 0
    for i, s in enumerate(supports):
        run = run + 1 if s >= CORE_SUPPORT else 0
        if not run:
            cut = i + 1
        if run == CORE_RUN:
            break
    return cut


@dataclass
class Flank:
    """A called flank, 5' to 3', with the support of its positions from the read edge inward."""

    sequence: str = ""
    supports: list[float] = field(default_factory=list)
    confidence: float = 0.0


def detect_flanks(reads: DataFrame) -> dict[int, dict]:
    """For each round: five and three (Flank), mean_length and random_length.

    reads: round and seq, or counts. A round with fewer than MIN_READS reads has no flanks. What comes to the driver is at most
    two sides of MAX_LEN rows for each round.
    """
    counts = counted(reads) if reads.is_cached else counted(reads).cache()
    both = [profiles.consensus(profiles.base_counts(counts, MAX_LEN, side)).withColumn("side", F.lit(side)) for side in (False, True)]
    consensus = both[0].unionByName(both[1]).cache()
    lengths = {(r["round"], r.side): r.boundary for r in flank_boundaries(consensus, "round", "side").collect()}
    found: dict[int, dict] = {}
    bases: dict[tuple[int, bool], list] = {}
    for r in consensus.orderBy("round", "side", "pos").collect():
        bases.setdefault((r["round"], r.side), []).append((r.base, r.support))
    consensus.unpersist()
    for (rnd, from_end), rows in bases.items():
        letters, supports = zip(*rows[: lengths[rnd, from_end]], strict=True) if lengths[rnd, from_end] else ((), ())
        sequence = "".join(reversed(letters) if from_end else letters)
        found.setdefault(rnd, {"five": Flank(), "three": Flank()})["three" if from_end else "five"] = Flank(sequence, list(supports))
    size = F.length("seq")
    asked = {"mean": F.bround(F.sum(size * F.col("reads")) / F.sum("reads")).cast("int")}
    for name, near in (("five", near_prefix), ("three", near_suffix)):
        # One expression for each different flank, not for each round.
        for i, flank in enumerate(sorted({f[name].sequence for f in found.values()} - {""})):
            mine = F.col("round").isin([k for k, f in found.items() if f[name].sequence == flank]) & (size >= len(flank))
            asked[f"{name}_{i}"] = F.sum(F.when(mine & near(F.col("seq"), flank), F.col("reads"))) / F.sum(F.when(mine, F.col("reads")))
    for r in counts.groupBy("round").agg(*[v.alias(k) for k, v in asked.items()]).collect():
        sides = found.setdefault(r["round"], {"five": Flank(), "three": Flank()})
        for name in ("five", "three"):
            sides[name].confidence = next((r[k] for k in asked if k.startswith(name) and r[k] is not None), 0.0)
        l5, l3 = len(sides["five"].sequence), len(sides["three"].sequence)
        sides |= {"mean_length": r["mean"], "random_length": r["mean"] - l5 - l3 if l5 or l3 else None}
    if counts is not reads:
        counts.unpersist()
    return found


def detect_from_counts(counts: DataFrame, top_n: int | None = None) -> dict[int, dict]:
    """detect_flanks of the unique sequences of counts (round, seq, reads), each weighing one.

    top_n: only so many of the most frequent of each round. A round with fewer than MIN_READS of them is left out.
    """
    chosen = (top(counts, top_n) if top_n else counts).select("round", "seq", F.lit(1).cast("long").alias("reads"))
    enough = chosen.groupBy("round").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_READS)
    return detect_flanks(chosen.join(enough.select("round"), "round", "left_semi"))


def shared_constant(reads: DataFrame, primer: str, from_end: bool = False) -> tuple[str, dict[int, int]]:
    """The part of a 5' flank (or a 3' one, from_end) that all rounds share, and its offset from the edge in each.

    reads: round and seq, or counts. The flank is anchored on its inner core; outer positions stay while every anchored round
    agrees. One pass finds the places of the core and one counts the bases outside it, with a row for each round, place and base.
    """
    if len(primer) <= CORE_LEN:
        return primer, {}
    if from_end:
        mirrored = counted(reads).select("round", F.reverse("seq").alias("seq"), "reads")
        kept, offsets = shared_constant(mirrored, primer[::-1])
        return kept[::-1], offsets
    core, outer = primer[-CORE_LEN:], primer[:-CORE_LEN]
    if primer.find(core) != len(outer):
        return primer, {}
    counts = counted(reads)
    window = len(primer) + SEARCH_SLACK
    every, places = {}, {}
    found = F.element_at(signals.single_place(F.col("seq"), core, window), 1)
    for r in counts.groupBy("round", found.alias("place")).agg(F.sum("reads").alias("n")).collect():
        every[r["round"]] = every.get(r["round"], 0) + r.n
        if r.place is not None:
            places.setdefault(r["round"], {})[r.place] = r.n
    best = {k: max(v, key=lambda p: (v[p], -p)) for k, v in places.items()}
    agreed = {k: p for k, p in best.items() if places[k][p] >= ANCHOR_AGREEMENT * sum(places[k].values())}
    here = F.create_map(*[x for k, v in agreed.items() for x in (F.lit(k), F.lit(v))]) if agreed else F.create_map().cast("map<int,int>")
    marked = counts.withColumn("place", here[F.col("round")])
    anchored = marked.where(F.col("place").isNotNull() & (F.substring("seq", F.col("place") + 1, F.lit(CORE_LEN)) == core))
    # k = 0 is a read that holds the core at its round's place.
    reached: dict[int, int] = {}
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(outer))))
    outside = anchored.select("round", "reads", "seq", "place", steps.alias("k")).where(F.col("place") >= F.col("k"))
    base = F.when(F.col("k") > 0, F.substring("seq", F.col("place") - F.col("k") + 1, F.lit(1))).otherwise("")
    outside = outside.select("round", "k", base.alias("base"), "reads").where(F.col("base").isin("", *"ACGT"))
    table: dict[tuple[int, int], dict[str, int]] = {}
    for r in outside.groupBy("round", "k", "base").agg(F.sum("reads").alias("n")).collect():
        if r.k:
            table.setdefault((r["round"], r.k), {})[r.base] = r.n
        else:
            reached[r["round"]] = r.n
    votes = {k for k, n in reached.items() if n >= MIN_ANCHORED * every[k]}
    if min(every, default=None) not in votes:
        return primer, {}
    kept = 0
    for k in range(1, len(outer) + 1):
        for rnd in votes:
            seen = table.get((rnd, k), {})
            total = sum(seen.values())
            top = max(seen, key=lambda b: (seen[b], b), default="")
            if top != outer[-k] or total < MIN_ANCHORED * reached[rnd] or seen[top] < FLOOR * total:
                return primer[len(outer) - kept :], {r: agreed[r] - kept for r in votes}
        kept = k
    return primer, {r: agreed[r] - kept for r in votes}


def composite(parts: dict[str, Column], one_round: bool = False) -> Column:
    """Weighted confidence; a missing part counts 0; clipped to [0, 1]."""
    weights = WEIGHTS_ONE_ROUND if one_round else WEIGHTS
    total = sum((F.coalesce(parts[k], F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def combined_persistence(five: Column, three: Column) -> Column:
    """The mean of both sides, or the one there is."""
    return F.coalesce((five + three) / 2, five, three)


def status(confidence: Column, has_rounds: Column) -> Column:
    raw = F.when(confidence >= HIGH, "HIGH").when(confidence >= MEDIUM, "MEDIUM").when(confidence >= LOW, "LOW").otherwise("UNABLE_TO_INFER")
    return F.when((raw == "HIGH") & ~has_rounds, "MEDIUM").otherwise(raw)


def classified(five: Column, three: Column, sharp: Column, split: Column, confidence: Column, has_rounds: Column) -> Column:
    """Struct of extraction_mode, full_insert, required_action and status from the signals."""
    refuse = ("UNABLE_TO_EXTRACT", False, "MANUAL_PRIMERS_REQUIRED")
    one_side = lambda rate, mode: ((rate > FOUND) & (sharp > SHARP_LENGTH), (mode, False, "NONE"))
    rules = [
        ((five < UNABLE) & (three < UNABLE), refuse),
        (split, ("PAIRED_END_SPLIT_PRIMERS", False, "READ_MERGING_RECOMMENDED")),
        ((five > FOUND) & (three > FOUND), ("BOTH_PRIMERS_SINGLE_READ", True, "NONE")),
        one_side(five, "FIVE_PRIME_ONLY"),
        (five > FOUND, refuse),
        one_side(three, "THREE_PRIME_ONLY"),
    ]
    parts = []
    for i, name in enumerate(("extraction_mode", "full_insert", "required_action")):
        value = F.lit(refuse[i])
        for condition, outcome in reversed(rules):
            value = F.when(condition, F.lit(outcome[i])).otherwise(value)
        parts.append(value.alias(name))
    return F.struct(*parts, F.when(parts[0] == refuse[0], "UNABLE_TO_INFER").otherwise(status(confidence, has_rounds)).alias("status"))


def without_adapters(primers: DataFrame) -> DataFrame:
    """primers (primer_5p, primer_3p) with those null that begin as a sequencing adapter does, and adapter_clean."""
    hit = {c: F.coalesce(starts_with_adapter(F.col(c)), F.lit(False)) for c in ("primer_5p", "primer_3p")}
    clean = ~(hit["primer_5p"] | hit["primer_3p"])
    return primers.withColumns({"adapter_clean": clean, **{c: F.when(~h, F.col(c)) for c, h in hit.items()}})


def unable_report(spark, reason: str, read_source: str = "RAW", seed: int = 0) -> DataFrame:
    """The report of a pool from which nothing can be inferred: one row that says why."""
    # The fields of a refusal.
    fixed = {"primer_5p": None, "primer_3p": None, "extraction_mode": "UNABLE_TO_EXTRACT", "full_insert": False, "required_action": "MANUAL_PRIMERS_REQUIRED", "orientation": "FORWARD", "status": "UNABLE_TO_INFER"}
    rates = dict.fromkeys(("n_length_confidence", "match_rate_5p", "match_rate_3p", "pos_5p", "pos_3p", "read_fraction", "confidence"), 0.0)
    row = {**fixed, **rates, "n_length": None, "read_source": read_source, "sampling_seed": seed, "failure_reason": reason}
    types = {**dict.fromkeys(fixed, "string"), "full_insert": "boolean", **dict.fromkeys(rates, "double"), "n_length": "int", "read_source": "string", "sampling_seed": "int", "failure_reason": "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[k]}" for k in row))


def is_adapter(primer: str) -> bool:
    probes = {x[:PROBE] for a in ADAPTERS.values() for x in (a, rc(a))}
    return primer.upper()[:PROBE] in probes


def _one_off(a: str, b: str) -> bool:
    return sum(x != y for x, y in zip(a, b, strict=True)) <= 1 if len(a) == len(b) else a in b or b in a


def library_report(reads: DataFrame, mates: DataFrame | None = None, has_rounds: bool | None = None) -> DataFrame:
    """One-row report of a pool: primers, rates, insert length, orientation, confidence and how to extract.

    reads: round, seq. mates: round, seq of the second reads, if there are any.
    """
    spark = reads.sparkSession
    pool = unique_counts(reads.select("round", normalised(F.col("seq")).alias("seq"))).cache()
    found = detect_flanks(pool)
    earliest = min(found, default=None)
    has_rounds = len(found) > 1 if has_rounds is None else has_rounds
    row = {"primer_5p": None, "primer_3p": None, "match_rate_5p": 0.0, "match_rate_3p": 0.0, "pos_5p": None, "pos_3p": None, "persistence": None, "n_length": None, "n_length_confidence": 0.0, "orientation": "FORWARD", "adapter_clean": True, "split": False}
    sides = found.get(earliest) or {"five": Flank(), "three": Flank()}
    primers = {}
    for name, flank in (("5p", sides["five"]), ("3p", sides["three"])):
        primer = flank.sequence
        if primer and is_adapter(primer):
            row["adapter_clean"], primer = False, ""
        primers[name] = primer
    where = {"5p": pool, "3p": pool}
    if mates is not None and primers["5p"]:
        other = unique_counts(mates.select("round", normalised(F.col("seq")).alias("seq"))).cache()
        second = detect_flanks(other.where(F.col("round") == earliest)).get(earliest, {}).get("five", Flank())
        agree = primers["3p"] and sides["three"].confidence > FOUND and _one_off(primers["3p"], rc(second.sequence))
        if sides["five"].confidence > FOUND and second.confidence > FOUND and not agree:
            row["split"], primers["3p"], where["3p"] = True, rc(second.sequence), other
    persist = {}
    for name in ("5p", "3p"):
        if not primers[name]:
            continue
        mirrored = row["split"] and name == "3p"
        probe = rc(primers[name]) if mirrored else primers[name]
        kept, offsets = shared_constant(where[name], probe, from_end=name == "3p" and not mirrored)
        trimmed, probe = kept != probe, kept
        primers[name] = rc(kept) if mirrored else kept
        rates = {r["round"]: r.match_rate for r in signals.match_rate(where[name], probe).collect()}
        flank = sides["five" if name == "5p" else "three"]
        if rates.get(earliest, 0.0) <= FOUND and not trimmed and not mirrored:
            cut = outer_cut(flank.supports)
            core = probe[cut:] if name == "5p" else probe[: len(probe) - cut]
            if cut and len(core) >= CORE_LEN:
                again = {r["round"]: r.match_rate for r in signals.match_rate(where[name], core).collect()}
                rates = {k: max(v, again.get(k, 0.0)) for k, v in rates.items()}
        row[f"match_rate_{name}"] = rates.get(earliest, 0.0)
        at = offsets.get(earliest, 0)
        first = where[name].where(F.col("round") == earliest)
        row[f"pos_{name}"] = signals.position_consistency(first, probe, at, SLACK, from_end=name == "3p" and not mirrored).first().consistency
        table = spark.createDataFrame(sorted(rates.items()), "round int, rate double")
        persist[name] = signals.persistence(table, "rate").first().persistence
    have = [v for v in persist.values() if v is not None]
    row["persistence"] = sum(have) / len(have) if have else None
    counts = pool.where(F.col("round") == earliest) if earliest is not None else None
    if counts is not None and (primers["5p"] or primers["3p"]) and not row["split"]:
        # The insert lies between the constants; what stands before the 5' one is this round's own.
        outside = len(sides["five"].sequence) if primers["5p"] else 0
        lengths = signals.insert_lengths(counts, outside, len(sides["three"].sequence) if primers["3p"] else 0).first()
        row["n_length"], row["n_length_confidence"] = lengths.mode_length, lengths.mode_share
    if primers["5p"] and primers["3p"] and not row["split"]:
        row["orientation"] = signals.orientation(signals.strands(pool.where(F.col("round") == earliest), primers["5p"], primers["3p"])).first().orientation
    row["primer_5p"], row["primer_3p"] = primers["5p"] or None, primers["3p"] or None
    for frame in set(where.values()) | {pool}:
        frame.unpersist()
    types = "primer_5p string, primer_3p string, match_rate_5p double, match_rate_3p double, pos_5p double, pos_3p double, persistence double, n_length int, n_length_confidence double, orientation string, adapter_clean boolean, split boolean"
    one = spark.createDataFrame([tuple(row.values())], types)
    parts = {"match_5p": F.col("match_rate_5p"), "match_3p": F.col("match_rate_3p"), "pos_5p": F.col("pos_5p"), "pos_3p": F.col("pos_3p"), "persistence": F.col("persistence"), "n_len": F.col("n_length_confidence"), "adapter_clean": F.col("adapter_clean").cast("double")}
    one = one.withColumn("confidence", composite(parts, not has_rounds))
    call = classified(F.col("match_rate_5p"), F.col("match_rate_3p"), F.col("n_length_confidence"), F.col("split"), F.col("confidence"), F.lit(has_rounds))
    one = one.withColumn("call", call).select("*", "call.*").drop("call")
    # An insert of no length means one molecule, not a library: refuse.
    empty = F.coalesce(F.col("n_length") == 0, F.lit(False))
    guard = {"extraction_mode": "UNABLE_TO_EXTRACT", "full_insert": False, "required_action": "MANUAL_PRIMERS_REQUIRED", "status": "UNABLE_TO_INFER"}
    return one.withColumns({k: F.when(empty, F.lit(v)).otherwise(F.col(k)) for k, v in guard.items()})
