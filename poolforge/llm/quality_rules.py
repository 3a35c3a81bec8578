"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Word unigrams and bigrams of a text are hashed to ``buckets`` buckets. Two smoothed multinomials over the buckets are
estimated, one from trusted documents and one from the whole corpus. A text's score is the sum of its features'
log ratios divided by their number; a text is kept if that mean reaches ``threshold``. Log ratios are rounded to
integers (millionths), so that sums and the decision do not depend on the order of addition.

Everything is DataFrame operations. Counting is one partial aggregation with at most ``buckets`` groups; scoring looks
up an array of ``buckets`` integers that arrives as a scalar subquery. Both multinomials cover all of their documents. Ids and
texts are shuffled once, to mark the trusted ones; ids are not broadcast, as their number grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, only, stored, words_of

BUCKETS = 1 << 16
THRESHOLD = -0.05
#: Prior count of each bucket on both sides.
PRIOR = 16.0
SCALE = 1_000_000
#: Multiplier that combines the hashes of two neighbouring words.
PAIR = 1_000_003


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _pairs(hashes: Column, buckets: int) -> Column:
    """For each word the buckets of its unigram and of the bigram that it begins (null for the last word)."""
    follow = F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(hashes, follow, lambda a, b: F.struct((a % buckets).cast("int").alias("u"), ((a * PAIR + b) % buckets).cast("int").alias("b")))


def log_ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, weight): round(1e6 * ln((t + prior) / (e + prior))); one row for each bucket.

    t is the bucket's count in trusted text, e the count it would have there if trusted text were like the corpus. The
    prior count shrinks the ratio of rare buckets towards zero: a word that is merely new says little.

    docs: doc_id, text. trusted: doc_id of trusted documents. A null id is never trusted. Repeated ids count once.
    """
    ids = only(trusted, "doc_id").where("doc_id is not null").distinct().withColumn("is_target", F.lit(1))
    # Hashed, not sorted: the side of the ids is small in each task, and the texts need no order.
    rows = only(docs, "doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left")
    feats = rows.select("is_target", F.inline(bind(_word_hashes(words_of(F.col("text"))), lambda h: _pairs(h, buckets))))
    both = feats.select("is_target", F.explode(F.array("u", "b")).alias("bucket")).where("bucket is not null")
    counts = both.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("is_target").alias("target"))
    # One small table of at most `buckets` rows: written, so that the corpus is counted once.
    counts = stored(counts.select(F.col("bucket").cast("long"), "raw", "target"), "quality_counts")
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    full = every.join(F.broadcast(counts), "bucket", "left").na.fill(0)
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_all"), F.coalesce(F.sum("target"), F.lit(0)).alias("target_all"))
    full = full.join(F.broadcast(total))
    expected = F.col("raw") * F.col("target_all").cast("double") / F.greatest(F.col("raw_all"), F.lit(1))
    ratio = F.log((F.col("target") + prior) / (expected + prior))
    return full.select("bucket", F.round(ratio * SCALE).cast("long").alias("weight"))


def _repeated(words: Column, h: Column) -> Column:
    """Words that stand in a three-word window found twice or more. h: the words' hashes."""
    n = F.size(h)
    bits = F.ceil(F.log2(n.cast("double"))).cast("int")

    def same(i: Column, j: Column) -> Column:
        return (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])

    def covered(grams: Column) -> Column:
        # A window's hash with its position in the low bits: equal windows are neighbours after a plain sort.
        packed = F.sort_array(F.transform(grams, lambda g, i: F.call_function("shiftleft", F.call_function("shiftright", g, bits), bits).bitwiseOR(i.cast("long"))))
        place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)).cast("int")
        last = F.size(grams) - 1

        def hits(s: Column) -> Column:
            def hit(x: Column, k: Column) -> Column:
                near = lambda y: (F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)) & same(place(x), place(y))
                return ((k > 0) & near(s[F.greatest(k - 1, F.lit(0))])) | ((k < last) & near(s[F.least(k + 1, last)]))

            return F.transform(F.filter(s, hit), place)

        return F.size(F.array_distinct(F.flatten(F.transform(bind(packed, hits), lambda i: F.array(i, i + 1, i + 2)))))

    grams = F.transform(F.slice(h, 1, n - 2), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))
    counted = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < 4, F.lit(0)).otherwise(counted)


def base_counts(text: Column, words: Column, hashes: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(full, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(words, hashes).cast("long").alias("n_repeat_words"),
    )


def _verdicts(frame: DataFrame, text: Column, table: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """frame with __out: struct of base, llr, n, base_failed and kept of the text."""
    weights = table.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w"))
    rows = frame.withColumn("__in", F.struct(words_of(text).alias("words"), weights.scalar().alias("weights")))

    def judge(x: Column) -> Column:
        def llr(h: Column) -> Column:
            zero, w = F.lit(0).cast("long"), x["weights"]
            return F.aggregate(_pairs(h, buckets), zero, lambda acc, p: acc + w[p["u"]] + F.coalesce(w[p["b"]], zero))

        def verdict(o: Column) -> Column:
            failed = (o["base"]["n_words"] < 50) | (100 * o["base"]["n_repeat_words"] > 50 * o["base"]["n_words"])
            good = o["llr"] >= F.lit(round(threshold * SCALE)) * o["n"]
            return F.struct(*[o[c].alias(c) for c in ("base", "llr", "n")], failed.alias("base_failed"), (~failed & good).alias("kept"))

        n = F.size(x["words"])
        counted = bind(
            _word_hashes(x["words"]),
            lambda h: F.struct(base_counts(text, x["words"], h).alias("base"), llr(h).alias("llr"), F.when(n > 0, 2 * n - 1).otherwise(0).cast("long").alias("n")),
        )
        return bind(counted, verdict)

    # The verdict is one field, so that a filter on it evaluates the whole expression once.
    return rows.withColumn("__out", bind(F.col("__in"), judge)).drop("__in")


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, the base counts, base_failed, llr_millionths, n_features and kept.

    docs: doc_id and text; further columns are never read. trusted: doc_id.
    A null or empty text has no words and fails the base rules. Repeated rows and repeated or null ids are judged row
    by row. Empty tables give no rows; without trusted ids all ratios come from the smoothing alone.
    base_failed: fewer than 50 words, or more than half of the words in a repeated three-word window.
    """
    rows = _verdicts(only(docs, "doc_id", "text"), F.col("text"), log_ratio_table(docs, trusted, buckets), buckets, threshold)
    base = [F.col(f"__out.base.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *base, "__out.base_failed", F.col("__out.llr").alias("llr_millionths"), F.col("__out.n").alias("n_features"), "__out.kept")


def kept_documents(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    rows = _verdicts(rows, F.col("__doc.text"), log_ratio_table(docs, trusted, buckets), buckets, threshold)
    return rows.where("__out.kept").select("__doc.*")
