"""Sources and small files: malformed and missing ones, empty tables, and what the queries over the driver's tables do not show."""

from __future__ import annotations

import gzip
import json

import pytest

from poolforge.operators import counts, inference, metadata, scoring
from poolforge.sources import fastq, releases, reports, tables


def test_cut_off_records(spark, tmp_path):
    path = tmp_path / "a.fastq"
    path.write_text("@1\nACGT\n+\nIIII\n@2\nAC")
    with pytest.raises(Exception, match="cut off"):
        fastq.read_fastq(spark, str(path)).collect()
    assert [r.seq for r in fastq.read_fastq(spark, str(path), mode="droptail").collect()] == ["ACGT"]


def test_each_file_says_what_it_is(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@1\nACGT\n+\nIIII\n@2\n\n+\n\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">1\nAC\nGT\n>2\n>3\nTT\n")
    (tmp_path / "c.fasta").write_text("")
    rows = fastq.read_sequences(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.rec, r.seq) for r in rows) == [("a.fastq", 0, "ACGT"), ("a.fastq", 1, ""), ("b.fasta.gz", 0, "ACGT"), ("b.fasta.gz", 1, ""), ("b.fasta.gz", 2, "TT")]


def test_written_records_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("x", "ACGTA", "IIIII"), ("y", "ACGT", "FFFF")], "name string, seq string, qual string").coalesce(1)
    fastq.write_fastq(rows, str(tmp_path / "q"))
    fastq.write_fasta(rows, str(tmp_path / "a"), width=4)
    assert [(r.name, r.seq, r.qual) for r in fastq.read_fastq(spark, f"{tmp_path}/q/part-*").collect()] == [("x", "ACGTA", "IIIII"), ("y", "ACGT", "FFFF")]
    assert [(r.name, r.seq) for r in fastq.read_fasta(spark, f"{tmp_path}/a/part-*").collect()] == [("x", "ACGTA"), ("y", "ACGT")]
    assert ">x\nACGT\nA\n>y\nACGT\n" in [p.read_text() for p in (tmp_path / "a").glob("part-*")]


def test_files_of_a_run_by_their_whole_name(spark):
    files = spark.createDataFrame([(f,) for f in ("SRR1_1.fastq.gz", "SRR1_2.fastq.gz", "SRR12_1.fastq.gz", "SRR12.fastq.gz", "notes.txt")], "file string")
    runs = spark.createDataFrame([("SRR1",), ("SRR1",)], "srr string")
    assert sorted(r.file for r in fastq.files_of_runs(files, runs).collect()) == ["SRR1_1.fastq.gz", "SRR1_2.fastq.gz"]
    mates = {r.file: r.mate_file for r in fastq.first_reads(files.where("file <> 'notes.txt'")).collect()}
    assert mates == {"SRR1_1.fastq.gz": "SRR1_2.fastq.gz", "SRR12_1.fastq.gz": None, "SRR12.fastq.gz": None}


def test_flags(spark, tmp_path):
    path = str(tmp_path / "flags.yaml")
    flags = spark.createDataFrame([("b", "warning", '{"10": 0.12345678, "x": [1]}'), ("a", "info", None)], "name string, severity string, evidence string")
    reports.write_flags(flags, path)
    assert reports.count_flags(spark, path) == 2 and "0.123457" in (tmp_path / "flags.yaml").read_text()
    reports.write_flags(flags.limit(0), path)
    assert reports.count_flags(spark, path) == 0
    (tmp_path / "flags.yaml").write_text("a: [b")
    assert reports.count_flags(spark, path) == 0


def test_seed_without_entries(spark, tmp_path):
    (tmp_path / "seed.yaml").write_text("blacklist:\n  - bioproject_id: PRJ1\nsmall_molecule_targets: [GTP]\n")
    seed = reports.read_seed(spark, str(tmp_path / "seed.yaml"))
    assert seed.studies.count() == 0 == seed.overrides.count() and seed.small_molecules == ["gtp"]
    assert [r.bioproject_id for r in seed.blacklist.collect()] == ["PRJ1"]


def test_truth_of_few_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("accession\tscore_3p\tverified\nA\tFALSE\ttrue\nB\t\tyes\n")
    rows = [(r.accession, r.score_3p, r.verified, r.n_length_truth, r.round_map_source) for r in reports.read_truth(spark, str(tmp_path / "t.tsv")).orderBy("accession").collect()]
    assert rows == [("A", False, True, 0, "auto"), ("B", True, False, 0, "auto")]


def test_baselines_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"n_in": 1')
    assert tables.read_trim_reports(spark, str(tmp_path / "bad.json")) is None
    assert tables.read_trim_reports(spark, str(tmp_path / "none.json")) is None
    assert tables.read_or_empty(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_manifest_keeps_paths_and_leaves_parquet_out(spark, tmp_path):
    for r in ("round_00", "round_01"):
        (tmp_path / "out" / r).mkdir(parents=True)
        (tmp_path / "out" / r / "x.fasta").write_text(r)
    (tmp_path / "out" / "c.parquet").write_text("")
    digest = reports.write_manifest(spark, str(tmp_path / "m.json"), {"status": "HIGH", "extraction_mode": "FIVE_PRIME_ONLY"}, None, str(tmp_path / "out"))
    row = json.loads((tmp_path / "m.json").read_text())
    assert list(row["output_sha256"]) == ["round_00/x.fasta", "round_01/x.fasta"] and row["input_sha256"] == {}
    assert row["extraction_mode"] == "FIVE_PRIME_ONLY" and len(digest) == 64


def test_release_comparison_of_equal_trees(spark, tmp_path):
    for tree in ("a", "b"):
        (tmp_path / tree).mkdir()
        (tmp_path / tree / "r.json").write_text(json.dumps({"x": [], "y": {"date": tree}, "at": f"{tmp_path}/{tree}/f"}))
        with gzip.open(tmp_path / tree / "s.fasta.gz", "wt", compresslevel=1 if tree == "a" else 9) as f:
            f.write(">1\nACGT\n")
    found = [releases.contents(spark, str(tmp_path / t)) for t in ("a", "b")]
    assert releases.compared(*found).count() == 0 and releases.compared(found[0], found[1].limit(0)).where("kind = 'MISSING'").count() == 3


def test_rounds_of_samples(spark):
    rows = [("S1", "P", "VEGF Round 2", '{"round": "3"}'), ("S2", "P", "", "{bad"), ("S3", "P", None, None), ("S4", "Q", "", "")]
    samples = spark.createDataFrame(rows, "srr string, bioproject_id string, sample_title string, sample_attributes string")
    seeds = spark.createDataFrame([("P", "S2", 5), ("P", "S4", 6)], "bioproject_id string, srr string, round int")
    out = {r.srr: (r.round_number, r.confidence, r.target_hint) for r in metadata.parse_sample_rounds(samples, overrides=seeds).collect()}
    assert out == {"S1": (3, "HIGH", "VEGF"), "S2": (5, "HIGH", ""), "S3": (None, "NONE", ""), "S4": (None, "NONE", "")}


def test_refusals_adapters_and_marks(spark):
    assert inference.unable_report(spark, "few").first().failure_reason == "few"
    primers = spark.createDataFrame([("agatcggaagagcAA", "ACGT"), (None, None)], "primer_5p string, primer_3p string")
    assert [(r.primer_5p, r.primer_3p, r.adapter_clean) for r in inference.without_adapters(primers).collect()] == [(None, "ACGT", False), (None, None, True)]
    kept, skipped = scoring.verified(spark.createDataFrame([("a", True), ("b", False), ("c", None)], "accession string, verified boolean"))
    assert [r.accession for r in kept.collect()] == ["a"] and sorted(r.accession for r in skipped.collect()) == ["b", "c"]
    assert counts.cached_stats(spark.createDataFrame([], "round int, seq string, reads long")).count() == 0
