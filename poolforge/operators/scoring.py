"""Scoring of inferred reports against documented truth, and agreement between annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement, without_barcode

AMBIGUOUS = "[RYKMSWBVDHNryksmwbvdhn]"
REFUSALS = (("status_UNABLE_TO_INFER", "status", "UNABLE_TO_INFER"), ("extraction_mode_UNABLE_TO_EXTRACT", "extraction_mode", "UNABLE_TO_EXTRACT"), ("required_action_MANUAL_PRIMERS_REQUIRED", "required_action", "MANUAL_PRIMERS_REQUIRED"))


def equivalence(observed: Column, truth: Column, barcodes: list[str] | None = None) -> Column:
    """How an observed primer relates to the true one: the first of eight kinds that applies."""
    o, t = F.upper(F.trim(observed)), F.upper(F.trim(F.coalesce(truth, F.lit(""))))
    ou, tu = F.translate(o, "U", "T"), F.translate(t, "U", "T")
    part = lambda f: f(tu, ou) | f(ou, tu)
    out = F.when(t.rlike(AMBIGUOUS), "IUPAC_UNSUPPORTED").when((t == "") | o.isNull() | (o == ""), "MISMATCH").when(o == t, "EXACT")
    if barcodes:
        out = out.when(without_barcode(o, [b.upper() for b in barcodes]) == t, "BARCODE_STRIPPED")
    out = out.when(ou == tu, "U_T_NORMALIZED").when(ou == reverse_complement(tu), "REVCOMP")
    return out.when(part(F.startswith), "PARTIAL_5P").when(part(F.endswith), "PARTIAL_3P").otherwise("MISMATCH")


def is_match(kind: Column) -> Column:
    return kind.isin("EXACT", "BARCODE_STRIPPED", "U_T_NORMALIZED", "REVCOMP")


def with_reports(truth: DataFrame, reports: DataFrame) -> DataFrame:
    """truth with the report of its accession, where there is one (has_report)."""
    return truth.join(reports.withColumn("has_report", F.lit(True)), "accession", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def primer_recovery(rows: DataFrame) -> DataFrame:
    """side, status (null: all), kind and n; the 3' side only where it is scored."""
    sides = F.array(F.struct(F.lit("5p").alias("side"), equivalence(F.col("primer_5p"), F.col("truth_5p")).alias("kind"), F.lit(True).alias("on")), F.struct(F.lit("3p").alias("side"), equivalence(F.col("primer_3p"), F.col("truth_3p")).alias("kind"), F.col("score_3p").alias("on")))
    each = rows.select(F.coalesce("status", F.lit("NO_REPORT")).alias("status"), F.explode(sides).alias("s")).where("s.on").select("status", "s.side", "s.kind")
    total = each.groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n")).select("side", F.lit("ALL").alias("status"), "kind", "n")
    return each.groupBy("side", "status", "kind").agg(F.count(F.lit(1)).alias("n")).select("side", "status", "kind", "n").unionByName(total)


def pair_recovery(rows: DataFrame) -> DataFrame:
    """status, bucket (exact, equivalent, partial, failed) and n of both primers together."""
    a, b = equivalence(F.col("primer_5p"), F.col("truth_5p")), equivalence(F.col("primer_3p"), F.col("truth_3p"))
    b = F.when(F.col("score_3p"), b).otherwise(a)
    some = is_match(a) | is_match(b) | a.startswith("PARTIAL") | b.startswith("PARTIAL")
    bucket = F.when((a == "EXACT") & (b == "EXACT"), "exact").when(is_match(a) & is_match(b), "equivalent").when(some, "partial").otherwise("failed")
    return rows.select(F.coalesce("status", F.lit("NO_REPORT")).alias("status"), bucket.alias("bucket")).groupBy("status", "bucket").agg(F.count(F.lit(1)).alias("n"))


def safe_failures(rows: DataFrame) -> DataFrame:
    """reason and n, with the number of rows that refuse for any reason as `any` and all rows as `evaluated`."""
    fired = [F.when(F.col(c) == v, F.lit(name)) for name, c, v in REFUSALS]
    reasons = F.when(~F.col("has_report"), F.array(F.lit("no_library_report"))).otherwise(F.filter(F.array(*fired), lambda x: x.isNotNull()))
    marked = rows.select(reasons.alias("reasons"))
    by = marked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    totals = marked.agg(F.count_if(F.size("reasons") > 0).alias("any"), F.count(F.lit(1)).alias("evaluated"))
    return by.unionByName(totals.unpivot([], ["any", "evaluated"], "reason", "n"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("NO_REPORT")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def length_recovery(rows: DataFrame, tolerance: int = 2) -> DataFrame:
    """bucket and n; lengths can be measured only where both primers were found on one read."""
    both = F.coalesce(F.col("extraction_mode") == "BOTH_PRIMERS_SINGLE_READ", F.lit(False))
    known = F.col("n_length").isNotNull() & (F.coalesce("truth_n", F.lit(0)) > 0)
    bucket = F.when(~both | ~known, "unmeasurable").when(F.abs(F.col("n_length") - F.col("truth_n")) <= tolerance, "in_tolerance").otherwise("out_of_tolerance")
    return rows.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def no_false_calls(rows: DataFrame) -> DataFrame:
    """read_state, how many were evaluated, and how many rightly have no primer."""
    clean = F.col("primer_5p").isNull() & F.col("primer_3p").isNull()
    return rows.groupBy("read_state").agg(F.count_if("has_report").alias("n_evaluated"), F.count_if(F.col("has_report") & clean).alias("n_correct"))


def average_ranks(x: DataFrame, column: str, out: str) -> DataFrame:
    """x with the average rank of column: ranks come from the histogram of its values, not from one sorted task."""
    by = x.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    below = by.withColumn("__below", F.coalesce(F.sum("__n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.join(below.select(column, (F.col("__below") + (F.col("__n") + 1) / 2).alias(out)), column)


def correlation(a: str, b: str) -> Column:
    varied = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0) & (F.count(F.lit(1)) >= 2)
    # Spelt out, as corr() fails on a column without variance.
    cov = F.covar_pop(a, b)
    return F.when(varied, F.round(F.try_divide(cov, F.stddev_pop(a) * F.stddev_pop(b)), 6))


def count_correlation(observed: DataFrame, reference: DataFrame, top: int = 100) -> DataFrame:
    """Pearson, Spearman and top-n Pearson of two count tables (seq, reads) over the union of their sequences."""
    o, r = observed.select("seq", F.col("reads").alias("a")), reference.select("seq", F.col("reads").alias("b"))
    x = o.join(r, "seq", "full").na.fill(0, ["a", "b"]).select("seq", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    ranks = average_ranks(average_ranks(x, "a", "ra"), "b", "rb")
    best = x.orderBy(F.desc("b"), "seq").limit(top)
    return ranks.agg(F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("pearson"), correlation("ra", "rb").alias("spearman")).join(F.broadcast(best.agg(correlation("a", "b").alias("pearson_top"))))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Cells of two arms (accession, field, value): agreement by field, and over all as field ALL."""
    a, b = one.select("accession", "field", F.col("value").alias("x")), two.select("accession", "field", F.col("value").alias("y"))
    cells = a.join(b, ["accession", "field"])
    call = F.when(F.col("x").isNull() & F.col("y").isNull(), "both_absent").when(F.col("x").isNull() | F.col("y").isNull(), "presence_mismatch").when(F.col("x") == F.col("y"), "agree").otherwise("disagree")
    names = ("agree", "disagree", "presence_mismatch", "both_absent")
    by = cells.select("field", call.alias("call")).rollup("field").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("call") == c).alias(c) for c in names], F.grouping("field").alias("g"))
    real = F.col("agree") + F.col("disagree")
    return by.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("field")).alias("field"), "n", *names, F.try_divide("agree", real).alias("substantive_rate"))


def in_one_arm(one: DataFrame, two: DataFrame) -> DataFrame:
    """accession and arm (one or two) of the accessions that only one arm has."""
    a, b = one.select("accession").distinct(), two.select("accession").distinct()
    return a.join(b, "accession", "left_anti").withColumn("arm", F.lit("one")).unionByName(b.join(a, "accession", "left_anti").withColumn("arm", F.lit("two")))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verified rows, and the accessions of the others; a null mark is none."""
    mark = F.coalesce("verified", F.lit(False))
    return rows.where(mark), rows.where(~mark).select("accession")


def metric_arms(rows: DataFrame) -> DataFrame:
    """Rows, reports and calls of high confidence by read state, and over all as arm all."""
    parts = (F.count(F.lit(1)).alias("n"), F.count_if("has_report").alias("n_reports"), F.count_if(F.col("status") == "HIGH").alias("n_high"), F.grouping("read_state").alias("g"))
    return rows.rollup("read_state").agg(*parts).select(F.when(F.col("g") == 1, "all").otherwise(F.col("read_state")).alias("arm"), "n", "n_reports", "n_high")


def corpus_audit(rows: DataFrame) -> DataFrame:
    """One row with the three denominators (sampled, with report, with a usable one) and the share of refusals among reports."""
    refusal = F.col("status") == "UNABLE_TO_INFER"
    return rows.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if("has_report").alias("n_with_report"), F.count_if(F.col("has_report") & ~refusal).alias("n_with_qc"), (F.count_if(refusal) / F.count_if("has_report")).alias("refused_share"))


def available_files(expected: DataFrame, available: DataFrame) -> DataFrame:
    """srr, n_expected and n_available of the runs' expected files (srr, file), by the names that are there (file)."""
    there = available.select("file", F.lit(1).alias("here")).distinct()
    return expected.join(there, "file", "left").groupBy("srr").agg(F.count(F.lit(1)).alias("n_expected"), F.count("here").alias("n_available"))


def three_way(cells: DataFrame) -> DataFrame:
    """bucket and n of cells with values a, b and c."""
    values = F.array_distinct(F.filter(F.array("a", "b", "c"), lambda x: x.isNotNull()))
    n = F.size(F.filter(F.array("a", "b", "c"), lambda x: x.isNotNull()))
    bucket = F.when(n == 0, "none").when((n == 3) & (F.size(values) == 1), "all_agree").when((n == 2) & (F.size(values) == 1), "two_agree").when(n == 1, "single").otherwise("conflict")
    return cells.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def call_category(called: Column, truth: Column) -> Column:
    """none, complete, partial or wrong: a call within the true constant is partial."""
    return F.when(called.isNull() | (called == ""), "none").when(called == truth, "complete").when(F.contains(truth, called), "partial").otherwise("wrong")


def run_outcome(status: Column, five: Column, three: Column, control: Column) -> Column:
    """Outcome of a synthetic run from its status and the categories of both calls, the first that applies."""
    refused = status == "UNABLE_TO_INFER"
    return F.when(status.isNull(), "error").when(control & refused, "control_refused").when(control, "wrong").when(refused, "refused").when((five == "wrong") | (three == "wrong"), "wrong").when((five == "complete") & (three == "complete"), "complete").otherwise("partial")


def outcome_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Outcomes of runs by keys, with coverage (accepted) and accuracy among accepted ones."""
    names = ("complete", "partial", "refused", "wrong", "error", "control_refused")
    by = runs.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    accepted = F.col("complete") + F.col("partial") + F.col("wrong")
    return by.withColumn("coverage", F.try_divide(accepted, accepted + F.col("refused") + F.col("error"))).withColumn("accuracy", F.try_divide(F.col("complete") + F.col("partial"), accepted))


def read_metrics(truth: DataFrame, emitted: DataFrame) -> DataFrame:
    """Precision, recall and exact-insert share of emitted reads (name, seq) against the truth (name, insert, on_target)."""
    x = truth.join(emitted.withColumn("out", F.lit(True)), "name", "left")
    out, right = F.coalesce("out", F.lit(False)), F.coalesce(F.col("seq") == F.col("insert"), F.lit(False))
    return x.agg(F.try_divide(F.count_if(out & F.col("on_target")), F.count_if(out)).alias("precision"), F.try_divide(F.count_if(out & F.col("on_target")), F.count_if(F.col("on_target"))).alias("recall"), F.try_divide(F.count_if(right & F.col("on_target")), F.count_if(out & F.col("on_target"))).alias("n_recovery"))


def yields(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Reads out by round before and after, zero where absent, and their difference."""
    a, b = baseline.select("round", F.col("n_out").alias("before")), new.select("round", F.col("n_out").alias("after"))
    return a.join(b, "round", "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def low_yields(trims: DataFrame) -> DataFrame:
    """Inputs that keep under half of their reads, or under half of the best share (input, n_in, n_out)."""
    share = trims.where("n_in > 0").withColumn("kept", F.col("n_out") / F.col("n_in"))
    best = share.agg(F.max("kept").alias("best"))
    return share.join(F.broadcast(best)).where("kept < 0.5 or kept < 0.5 * best").select("input", "kept")
