"""Unit expectations of the engine's operators on small literal tables."""

from __future__ import annotations

import gzip
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from poolforge import plans, registry  # noqa: F401 (plans registers the queries)
from poolforge.functions import sequences as S
from poolforge.operators import batch, counts, extraction, inference, metadata, profiles, qc, scoring, signals, trimming
from poolforge.sources import fastq, tables, trees

FIVE, THREE = "GGTAATACGACTCACTATAGGG", "CCATGCATGCATGCATGCAT"


def insert(i: int, n: int = 30) -> str:
    return "".join(random.Random(i).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(r, FIVE + insert(i % (1000 // (r + 1))) + THREE) for r in range(3) for i in range(1000)]
    return spark.createDataFrame(rows, "round int, seq string").cache()


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_entropy_of_equal_counts(spark):
    r = counts.round_stats(table(spark, [(1, s, 5) for s in "ACGT"], "round int, seq string, reads long")).first()
    assert (r.shannon_bits, r.top1_share, r.n_singletons) == (2.0, 0.25, 0)


def test_reverse_complement(spark):
    x = table(spark, [("ACGU",), ("acgN",)], "s string").select(S.reverse_complement(F.col("s")).alias("r"))
    assert [r.r for r in x.collect()] == ["ACGT", "Ncgt"]
    with pytest.raises(Exception, match="not a nucleotide"):
        table(spark, [("AXZ!",)], "s string").select(S.primer_reverse_complement(F.col("s"))).collect()


def test_hamming_and_occurrences(spark):
    x = table(spark, [("GAAAA", "GATAA")], "a string, b string")
    r = x.select(S.hamming(F.col("a"), F.col("b")).alias("h"), S.hamming_le1(F.col("a"), F.lit("GATA")).alias("l"), S.occurrences(F.col("a"), "AA").alias("o")).first()
    assert (r.h, r.l, r.o) == (1, False, [1, 2, 3])


def test_rarefied_draw_is_exact_and_repeats(spark):
    c = table(spark, [(1, "A", 70), (1, "C", 20), (1, "G", 10)], "round int, seq string, reads long")
    one, two = (sorted(counts.rarefied(c, 30).collect()) for _ in range(2))
    assert one == two and sum(r.reads for r in one) == 30
    assert sum(r.reads for r in counts.rarefied(c, 500).collect()) == 100
    with pytest.raises(ValueError):
        counts.rarefied(c, 0)
    assert counts.expected_uniques(c, 100).first().expected_unique == 3.0


def test_profile_sums_equal_reads(pool):
    c = counts.unique_counts(pool)
    assert {r.n for r in profiles.base_counts(c, 20).groupBy("round", "pos").agg(F.sum("n").alias("n")).collect()} == {1000}


def plain_boundary(supports):
    """The rule in plain Python."""
    n = len(supports)
    if n < 14:
        return 0
    end = n
    for i in range(n - 1):
        two = max(supports[i : i + 2])
        base = statistics.median(supports[i - 14 : i]) if i >= 14 else 0
        if two < 0.55 or (base >= 0.90 and supports[i] <= base - 0.12 and two < 0.85):
            end = i
            break
    strong = sum(s >= 0.75 for s in supports[:end])
    return end if end >= 14 and strong >= 0.8 * end else 0


def test_boundary_rules(spark):
    profiles_ = [[0.99] * 10, [0.99] * 20 + [0.3] * 10, [0.99] * 20 + [0.84, 0.80] + [0.5] * 10, [0.6] * 30]
    assert [plain_boundary(p) for p in profiles_] == [0, 20, 20, 0]
    rng = random.Random(6)
    profiles_ += [[rng.choice([0.5, 0.56, 0.7, 0.76, 0.84, 0.91, 0.97]) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    profiles_ += [[rng.choice([0.91, 0.97, 0.99]) for _ in range(rng.randint(10, 30))] + [rng.choice([0.3, 0.6, 0.8, 0.86]) for _ in range(rng.randint(0, 20))] for _ in range(60)]
    rows = [(k, i, s) for k, p in enumerate(profiles_) for i, s in enumerate(p)]
    found = {r["round"]: r.boundary for r in inference.flank_boundaries(table(spark, rows, "round int, pos int, support double")).collect()}
    assert found == {k: plain_boundary(p) for k, p in enumerate(profiles_)}


def test_strict_three_prime_start_equals_plain_search(spark):
    from poolforge.operators import trimming

    rng = random.Random(9)
    primer = "CCATGCATGCATGCATGCAT"

    def plain(read):
        best = None
        for i in range(len(read)):
            part = read[i : i + len(primer)]
            errors = sum(a != b for a, b in zip(part, primer, strict=False))
            if len(part) >= 3 and errors <= int(0.1 * len(part)) and (i + len(primer) <= len(read) or i + len(part) == len(read)):
                rank = (errors - len(part), errors, i)
                best = min(best, rank) if best else rank
        return best[2] if best else -1

    reads = []
    for _ in range(300):
        word = list(primer[: rng.choice([20, 20, 19, 12, 8, 4, 2])])
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice("ACGT")
        reads.append("".join(rng.choices("ACGT", k=rng.randint(0, 25))) + rng.choice(["", "CCAT", "CATG"]) + "".join(word) + ("".join(rng.choices("ACGT", k=rng.randint(0, 6))) if rng.random() < 0.5 else ""))
    df = table(spark, list(enumerate(reads)), "id int, seq string")
    found = {r.id: r.at for r in df.select("id", trimming._three_start(F.col("seq"), primer, 0.1).alias("at")).collect()}
    assert found == {i: plain(r) for i, r in enumerate(reads)}
    longer = {r.id: r.at for r in df.select("id", trimming._three_start(F.col("seq"), primer + primer[::-1], 0.1).alias("at")).collect()}
    assert set(longer) == set(found)


def test_near_pattern_means_the_same():
    from poolforge.functions.sequences import near_pattern, one_off_pattern

    rng = random.Random(10)
    for word in ("A", "AC", "ACG", "ACGTTGCA"):
        for _ in range(200):
            text = "".join(rng.choices("ACGT", k=rng.randint(0, 14)))
            assert bool(re.search(near_pattern(word), text)) == bool(re.search(one_off_pattern(word), text))


def test_outer_cut():
    assert inference.outer_cut([0.75, 0.90, 0.90, 0.89, 0.48, 0.61, 0.90, 0.91, 0.98, 0.77]) == 6
    assert inference.outer_cut([0.99] * 5) == 0


def test_clean_pool_is_called(pool):
    r = inference.library_report(pool).first()
    assert (r.primer_5p, r.primer_3p, r.n_length) == (FIVE, THREE, 30)
    assert (r.extraction_mode, r.full_insert, r.required_action, r.status) == ("BOTH_PRIMERS_SINGLE_READ", True, "NONE", "HIGH")


def test_five_prime_only_and_refusals(spark):
    one = table(spark, [(0, FIVE + insert(i)) for i in range(800)], "round int, seq string")
    assert inference.library_report(one).first().extraction_mode == "FIVE_PRIME_ONLY"
    few = table(spark, [(0, FIVE + insert(i) + THREE) for i in range(100)], "round int, seq string")
    assert inference.library_report(few).first().status == "UNABLE_TO_INFER"
    same = table(spark, [(0, FIVE + insert(1) + THREE)] * 600, "round int, seq string")
    assert inference.library_report(same).first().extraction_mode == "UNABLE_TO_EXTRACT"


def test_adapter_is_no_primer():
    assert inference.is_adapter("AGATCGGAAGAGCTTT") and not inference.is_adapter(FIVE)


def test_reverse_reads_are_noticed(spark):
    reads = [(0, S.rc(FIVE + insert(i) + THREE)) for i in range(50)]
    found = signals.strands(table(spark, reads, "round int, seq string"), FIVE, THREE)
    assert signals.orientation(found).first().orientation == "REVERSE"


def test_jaccard_of_empty_and_disjoint(spark):
    sets = table(spark, [(1, "AAC"), (2, "AAG")], "round int, kmer string")
    rounds = table(spark, [(1,), (2,), (3,), (4,)], "round int")
    d = {(r.a, r.b): r.distance for r in qc.jaccard_distances(sets, rounds).collect()}
    assert d[1, 2] == 1.0 and d[3, 4] == 0.0 and d[1, 3] == 1.0


def test_worst_ignores_info(spark):
    f = lambda *s: qc.worst(table(spark, [(x,) for x in s], "status string")).first().worst
    assert (f("INFO", "PASS"), f("WARN", "PASS"), f("WARN", "FAIL")) == ("PASS", "WARN", "FAIL")


def test_round_titles(spark):
    titles = {"7_cyc": 7, "12 cycles": 12, "Selex_3_cyc": 3, "Round 3": 3, "TFR1": None, "naive library": None, "DNAFOXR04": 4}
    x = metadata.parse_rounds(table(spark, [(t,) for t in titles], "sample_title string"))
    assert {r.sample_title: r.round_number for r in x.collect()} == titles


def test_several_rounds_are_unassigned(spark):
    x = metadata.parse_rounds(table(spark, [("R1 pool 2",)], "sample_title string")).withColumn("un", metadata.is_unassigned()).first()
    assert x.round_candidates == [2, 1] and x.confidence == "MEDIUM" and x.un


def test_strategies(spark):
    x = table(spark, [("",), ("AMPLICON",), ("RNA-Seq",), ("rna-seq",)], "s string").select(metadata.compatible_strategy(F.col("s")).alias("ok"))
    assert [r.ok for r in x.collect()] == [True, True, False, True]


def test_blacklist_context(spark):
    rows = [("p", "protein", "ATP was bound by an aptamer"), ("p", "protein", "ATP " + "x" * 300 + " aptamer"), ("p", "", "whole cell work"), ("bad", "x", "")]
    x = table(spark, rows, "id string, target string, abstract string")
    got = x.select(metadata.blacklisted(F.col("id"), F.col("target"), F.col("abstract"), ["bad"], ["atp"]).alias("b"))
    assert [r.b for r in got.collect()] == [True, False, True, True]


def test_semicolon_lists_lose_spaces_alone(spark):
    cells = {"0a0;11; 2;a;4;": ["0a0", "11", "2", "a", "4"], " ; b ;;\u00a0c\u3000;\u2003": ["b", "c"], "\t;d": ["\t", "d"], "": [], None: []}
    x = table(spark, [(c,) for c in cells], "c string").select("c", metadata.semicolon_list(F.col("c")).alias("l"))
    assert {r.c: r.l for r in x.collect()} == cells


def test_fetch_plan_keeps_digits(spark):
    x = table(spark, [("S", "a_1.gz; a_2.gz", "0f0;1e1", "1200; 311")], "srr string, fastq_ftp string, fastq_md5 string, fastq_bytes string")
    r = metadata.fetch_plan(x).first()
    assert (r.fastq_urls, r.fastq_md5s, r.fastq_bytes, r.paired_end) == (["a_1.gz", "a_2.gz"], ["0f0", "1e1"], [1200, 311], True)


def test_semicolon_list_query_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    urls = ["https://a.example/en/44444/", "https://a.example/en/4", "http://1/22/3", "a/ /\u00a0/b\u2003/\t", "a;b", "/", " ", "", None]
    table(spark, list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = registry.ORACLES["f22_semicolon_list"]
    wanted = duckdb.sql(f"with pages as (from '{tmp_path}/pages.parquet/*.parquet') {sql}").fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["f22_semicolon_list"](spark, str(tmp_path)).collect()) == sorted(wanted)


def test_equivalence_kinds(spark):
    rows = [("ACGT", "ACGT"), ("ACGU", "ACGT"), ("AACC", "GGTT"), ("ACG", "ACGTT"), ("GTT", "ACGTT"), ("TTTT", "ACGC"), (None, "ACGC"), ("ACGT", "ACGN"), ("XXACGT", "ACGT")]
    x = table(spark, rows, "o string, t string").select(scoring.equivalence(F.col("o"), F.col("t"), ["XX"]).alias("k"))
    assert [r.k for r in x.collect()] == ["EXACT", "U_T_NORMALIZED", "REVCOMP", "PARTIAL_5P", "PARTIAL_3P", "MISMATCH", "MISMATCH", "IUPAC_UNSUPPORTED", "BARCODE_STRIPPED"]


def test_correlation_without_variance_is_null(spark):
    c = table(spark, [("A", 5), ("C", 5)], "seq string, reads long")
    r = scoring.count_correlation(c, c).first()
    assert r.n == 2 and r.pearson is None and r.spearman is None


def test_trims_agree_on_clean_reads_and_allow_gaps(spark):
    clean = table(spark, [(i, FIVE + insert(i) + THREE) for i in range(40)], "rec int, seq string")
    strict = {r.rec: r.seq for r in trimming.strict_trim(clean, FIVE, THREE).collect()}
    linked = {r.rec: r.seq for r in trimming.linked_trim(clean, FIVE, THREE).collect()}
    assert strict == linked == {i: insert(i) for i in range(40)}
    gap = table(spark, [(1, FIVE[:10] + FIVE[11:] + insert(3) + THREE)], "rec int, seq string")
    assert trimming.linked_trim(gap, FIVE, THREE).first().seq == insert(3)
    assert trimming.strict_trim(gap, FIVE, THREE).count() == 0
    cut = table(spark, [(1, "A" * 30 + THREE[:8])], "rec int, seq string")
    assert trimming.linked_trim(cut, three=THREE).first().seq == "A" * 30
    assert trimming.Aligner("ACGTNNACGT").find("TTACGTGAACGTTT") == (2, 12)


def test_demultiplexing_conserves_reads(spark):
    reads = table(spark, [(1, "ATTGTAAAA"), (2, "ATTGAAAAA"), (3, "CCGCCTTTT"), (4, "GGGGGGGGG")], "rec int, seq string")
    out = {r.rec: (r.round, r.seq) for r in trimming.demultiplexed(reads, [("ATTGT", 1), ("CCGCC", 5)]).collect()}
    assert out == {1: (1, "AAAA"), 2: (1, "AAAA"), 3: (5, "TTTT"), 4: (None, "GGGGGGGGG")}
    with pytest.raises(ValueError):
        trimming.check_barcodes(["ATTGT", "ATTGA"])


def test_fastq_round_trip(spark, tmp_path):
    path = tmp_path / "SRR1_1.fastq.gz"
    with gzip.open(path, "wt") as f:
        f.write("".join(f"@r{i}\n{insert(i)}\n+\n{'I' * 30}\n" for i in range(5)))
    rows = fastq.read_fastq(spark, str(path)).orderBy("rec").collect()
    assert [(r.name, r.seq) for r in rows] == [(f"r{i}", insert(i)) for i in range(5)]
    assert fastq.read_fastq_text(spark, str(path)).count() == 5
    r = fastq.read_fastq(spark, str(path)).select(*fastq.mate_and_run(F.col("file"))).first()
    assert (r.srr, r.mate) == ("SRR1", 1)
    with gzip.open(path, "at") as f:
        f.write("@cut\nACGT\n")
    with pytest.raises(Exception, match="cut off"):
        fastq.read_fastq(spark, str(path)).collect()
    assert fastq.read_fastq(spark, str(path), mode="droptail").count() == 5


def test_fasta_and_sniffing(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">a\nAC\nGT\n>empty\n>b\nTT\n")
    assert [r.seq for r in fastq.read_fasta(spark, str(path)).orderBy("rec").collect()] == ["ACGT", "TT"]
    assert fastq.read_sequences(spark, str(path)).count() == 3


def test_sinks_are_deterministic(spark, tmp_path):
    reads = table(spark, [("f", i, f"r{i}", insert(i)) for i in range(20)], "file string, rec long, name string, seq string")
    paths = [tmp_path / f"{k}.fasta.gz" for k in "ab"]
    for p in paths:
        assert tables.write_fasta_gz(reads.repartition(3), str(p)) == 20
    assert paths[0].read_bytes() == paths[1].read_bytes()
    digest = tables.write_json({"a": 1, "m": {10: 1, 9: 2}}, str(tmp_path / "x.json"))
    assert len(digest) == 64 and list(tables.read_json(str(tmp_path / "x.json"))["m"]) == ["9", "10"]
    c = table(spark, [(1, "A", 3)], "round int, seq string, reads long")
    assert tables.write_counts(c, str(tmp_path / "c")) and not tables.write_counts(c.limit(0), str(tmp_path / "d"))
    assert tables.read_counts(spark, str(tmp_path / "c")).first().reads == 3


def test_round_map_refuses_double_names(spark, tmp_path):
    path = tmp_path / "rounds.tsv"
    path.write_text("file\tround_number\na/x.fastq\t1\nb/x.fastq\t2\n")
    with pytest.raises(ValueError):
        tables.read_round_map(spark, str(path))


def test_batch_turns_errors_into_rows():
    def fail(name):
        raise RuntimeError("no\ttabs")

    out = batch.run_batch(["b", "a"], {"fetch": lambda n: None, "detect": fail}, done={("a", "detect")})
    assert [(r["dataset"], r["status"]) for r in out] == [("a", "SUCCESS"), ("b", "DETECT_FAILED")] and out[1]["notes"] == "no tabs"


def test_simulated_pool_recovers_inserts(spark):
    reads = batch.simulated_pool(spark, FIVE, THREE, 2, 300, error=0.0)
    got = trimming.strict_trim(reads, FIVE, THREE)
    assert got.where("seq <> insert").count() == 0 and got.count() == 600


def test_streamed_counts_equal_batch(spark, tmp_path):
    from poolforge.streaming.counts import running_counts

    rows = table(spark, [(i % 2, insert(i % 5)) for i in range(50)], "round int, seq string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("running").collect()) == sorted(counts.unique_counts(rows).collect())


def test_text_reader_numbers_records_across_blocks(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.fastq").write_text("".join(f"@r{i}\n{insert(i)}\n+\n{'I' * 30}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = fastq.read_fastq_text(spark, str(tmp_path / "*" / "x.fastq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r.file for r in found}) == 2
    assert sorted((r.rec, r.seq) for r in found) == sorted((i, insert(i)) for i in range(2000) for _ in range(2))


def test_pairs_meet_within_their_run(spark):
    first = table(spark, [("S1", 0, "A"), ("S2", 0, "C")], "srr string, rec long, seq string")
    second = table(spark, [("S1", 0, "G"), ("S2", 0, "T")], "srr string, rec long, seq string")
    assert {(r.srr, r.seq, r.mate_seq) for r in fastq.paired(first, second).collect()} == {("S1", "A", "G"), ("S2", "C", "T")}


def _write_round(folder, name, reads):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as f:
        f.write("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))


def test_tree_of_rounds(spark, tmp_path):
    for target in ("alpha", "beta", "unassigned"):
        _write_round(tmp_path / target / "round_01", "SRR1_1.fastq.gz", ["ACGT", "ACGT", target[0].upper() * 4])
        _write_round(tmp_path / target / "round_01", "SRR1_2.fastq.gz", ["TTTT"])
    _write_round(tmp_path / "alpha" / "round_01", "SRR2.fastq.gz", ["ACGT"])
    _write_round(tmp_path / "alpha" / "round_naive", "SRR3.fastq.gz", ["GGGG"])
    counted = extraction.tree_counts(trees.read_round_tree(spark, str(tmp_path)))
    rows = {(r.target, r.label, r["round"], r.seq): r.reads for r in counted.collect()}
    assert rows == {("alpha", "round_01", 1, "ACGT"): 3, ("alpha", "round_01", 1, "AAAA"): 1, ("alpha", "round_naive", None, "GGGG"): 1, ("beta", "round_01", 1, "ACGT"): 2, ("beta", "round_01", 1, "BBBB"): 1}
    stats = {(r.target, r.label): (r.n_reads, r.n_unique, r.n_singletons) for r in extraction.tree_stats(counted).collect()}
    assert stats[("alpha", "round_01")] == (4, 2, 1)
    assert {r.large_enough for r in trees.valid_fastq_files(spark, str(tmp_path)).collect()} == {False}
    _write_round(tmp_path / "round_02", "SRR4.fastq.gz", ["ACGT"])
    with pytest.raises(ValueError, match="both"):
        trees.read_round_tree(spark, str(tmp_path))


def test_tree_of_one_target(spark, tmp_path):
    _write_round(tmp_path / "round_03", "SRR1.fastq.gz", ["ACGT", "", "ACGT"])
    rows = extraction.tree_counts(trees.read_round_tree(spark, str(tmp_path))).collect()
    assert [(r.target, r["round"], r.seq, r.reads) for r in rows] == [(None, 3, "ACGT", 2)]


def test_merged_inputs_keep_their_order(spark):
    parts = table(spark, [(1, f, i, f"{f}{i}") for f in ("b", "a", "c") for i in range(5)] + [(2, "a", 0, "x")], "round int, file string, rec long, seq string")
    rows = extraction.merged_inputs(parts).where("round = 1").orderBy("rec").collect()
    assert [r.seq for r in rows] == [f"{f}{i}" for f in "abc" for i in range(5)] and [r.rec for r in rows] == list(range(15))


def test_extraction_follows_the_report(spark):
    core = [insert(i) for i in range(20)]
    reads = table(spark, [(1, FIVE + c + THREE) for c in core] + [(2, "ACGT" * 20)], "round int, seq string")
    report = {"primer_5p": FIVE, "primer_3p": THREE, "extraction_mode": "BOTH_PRIMERS_SINGLE_READ", "status": "HIGH", "orientation": "FORWARD"}
    done = extraction.run_extract(reads, report)
    assert sorted(r.seq for r in done.reads.collect()) == sorted(core)
    assert {(r["round"], r.n_in, r.n_out) for r in done.yields.collect()} == {(1, 20, 20), (2, 1, 0)}
    turned = extraction.run_extract(trimming.reoriented(reads), {**report, "orientation": "REVERSE"})
    assert sorted(r.seq for r in turned.reads.collect()) == sorted(core)
    assert "refuses" in extraction.run_extract(reads, {**report, "status": "UNABLE_TO_INFER"}).skipped_reason
    assert "pair" in extraction.run_extract(reads, {**report, "extraction_mode": "PAIRED_END_SPLIT_PRIMERS"}).skipped_reason
    assert "unknown" in extraction.run_extract(reads, {**report, "extraction_mode": "OTHER"}).skipped_reason
    rescued = extraction.run_extract(reads, {"status": "UNABLE_TO_INFER"}, three=THREE)
    assert rescued.mode == "THREE_PRIME_ONLY" and sorted(r.seq for r in rescued.reads.collect()) == sorted(FIVE + c for c in core)


def test_extraction_demultiplexes_first(spark):
    reads = table(spark, [("ATTGT" + FIVE + insert(1) + THREE,), ("CTGAG" + FIVE + insert(2) + THREE,), ("GGGGG" + FIVE + insert(3) + THREE,)], "seq string")
    report = {"primer_5p": FIVE, "primer_3p": THREE, "extraction_mode": "BOTH_PRIMERS_SINGLE_READ", "status": "HIGH"}
    done = extraction.run_extract(reads, report, barcodes=[("ATTGT", 1), ("CTGAG", 2)])
    assert {(r["round"], r.seq) for r in done.reads.collect()} == {(1, insert(1)), (2, insert(2))}


def test_flanks_of_counts_weigh_uniques_once(spark):
    rows = [(1, FIVE + insert(i) + THREE, 1) for i in range(600)] + [(1, "T" * 72, 100_000)] + [(2, FIVE + insert(i) + THREE, 9) for i in range(400)]
    found = inference.detect_from_counts(table(spark, rows, "round int, seq string, reads long"))
    assert list(found) == [1] and found[1]["five"].sequence == FIVE and found[1]["random_length"] == 30
    assert inference.detect_from_counts(table(spark, rows, "round int, seq string, reads long"), top_n=100) == {}


def test_batch_statuses_and_resume():
    ran = []

    def step(stage):
        def run(name, fields):
            ran.append((name, stage))
            if name == "bad" and stage == "count":
                raise ValueError("two\nlines")
            if name == "no" and stage == "extract":
                raise batch.Refused("status")
            return {"required_action": "READ_MERGING_RECOMMENDED"} if name == "split" and stage == "detect" else {}

        return run

    steps = {s: step(s) for s in batch.STAGES}
    rows = batch.run_accessions(["bad", "no", "split", "good"], steps, lambda name, stage: {"runs": 1} if (name, stage) == ("good", "fetch") else None)
    assert [(r["status"], r["last_stage_completed"]) for r in rows] == [("COUNT_FAILED", "extract"), ("EXTRACT_REFUSED", "detect"), ("SKIPPED_READ_MERGING_RECOMMENDED", "extract"), ("OK", "qc")]
    assert rows[0]["notes"] == "ValueError: two lines" and rows[3]["runs"] == 1 and ("good", "fetch") not in ran and ("split", "count") not in ran
    assert len(batch.run_accessions(["bad", "good"], steps, stop_on_error=True)) == 1
