"""Queries on nucleotide and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import metadata as M
from ..registry import query
from . import derived as D

_RC = f"reverse(translate({{}}, '{S.SYMBOLS}', '{S.COMPLEMENTS}'))"
_DIFFER = "list_sum(list_transform(range(1, {n} + 1), lambda i: case when substr({a}, i, 1) = substr({b}, i, 1) then 0 else 1 end))"


def _reads(spark, sf):
    return D.reads(spark, sf)


@query("p01_normalised", f"with {D.READS} select rec, translate(upper(lower(seq)), 'U', 'T') as seq from reads")
def p01(spark, sf):
    return _reads(spark, sf).select("rec", S.normalised(F.lower("seq")).alias("seq"))


@query("p15_alphabet", f"with {D.READS} select round, count(*) filter (regexp_matches(seq, '[^ACG]')) as n from reads group by round")
def p15(spark, sf):
    return _reads(spark, sf).groupBy("round").agg(F.count_if(F.col("seq").rlike("[^ACG]")).alias("n"))


@query("p17_residue_tests", f"with {D.READS} select round, count(*) filter (starts_with(seq, 'ATTGTGGTAATACGA')) as starts, count(*) filter (ends_with(seq, 'CATGCATGCATGCAT')) as ends from reads group by round")
def p17(spark, sf):
    s = F.col("seq")
    return _reads(spark, sf).groupBy("round").agg(F.count_if(s.startswith("ATTGTGGTAATACGA")).alias("starts"), F.count_if(s.endswith("CATGCATGCATGCAT")).alias("ends"))


@query("f01_reverse_complement", f"with {D.READS} select rec, {_RC.format('seq')} as rc from reads")
def f01(spark, sf):
    return _reads(spark, sf).select("rec", S.reverse_complement(F.col("seq")).alias("rc"))


@query("f02_primer_reverse_complement", f"with {D.READS} select rec, {_RC.format('upper(seq)')} as rc from reads")
def f02(spark, sf):
    return _reads(spark, sf).select("rec", S.primer_reverse_complement(F.lower("seq")).alias("rc"))


@query("f03_hamming_le1", f"with {D.READS}, x as (select rec, substr(seq, length(seq) - 19, 20) as a from reads) select rec, {_DIFFER.format(n=20, a='a', b=repr(D.THREE))} <= 1 as near from x")
def f03(spark, sf):
    a = F.substring("seq", F.length("seq") - 19, F.lit(20))
    return _reads(spark, sf).select("rec", S.hamming_le1(a, F.lit(D.THREE)).alias("near"))


@query("f04_hamming", f"with {D.INSERTS}, x as (select seq, reverse(seq) as b, round from icounts) select round, seq, cast({_DIFFER.format(n=30, a='seq', b='b')} as integer) as d from x")
def f04(spark, sf):
    from ..operators.counts import unique_counts

    return unique_counts(D.inserts(spark, sf)).select("round", "seq", S.hamming(F.col("seq"), F.reverse("seq")).alias("d"))


@query("f05_contains_one_off", f"with {D.READS} select rec, regexp_matches(seq, '{S.one_off_pattern('ATGCATGGATGCA')}') as hit from reads")
def f05(spark, sf):
    return _reads(spark, sf).select("rec", S.contains_one_off(F.col("seq"), "ATGCATGGATGCA").alias("hit"))


@query("f07_adapter_prefix", f"with {D.INSERTS} select count(*) filter (substr(seq, 1, 13) in ('AGATCGGAAGAGC', 'GCTCTTCCGATCT', 'CTGTCTCTTATAC', 'AGATGTGTATAAG')) as n, count(*) as total from inserts")
def f07(spark, sf):
    return D.inserts(spark, sf).agg(F.count_if(S.starts_with_adapter(F.col("seq"))).alias("n"), F.count(F.lit(1)).alias("total"))


@query("f08_canonical_kmer", f"with {D.INSERTS} select distinct substr(seq, 1, 8) as kmer, least(substr(seq, 1, 8), {_RC.format('substr(seq, 1, 8)')}) as canonical from icounts")
def f08(spark, sf):
    k = F.substring("seq", 1, 8)
    return D.inserts(spark, sf).select(k.alias("kmer"), S.canonical(k).alias("canonical")).distinct()


@query("f09_canonical_kmers", f"with {D.INSERTS}, x as (select distinct round, seq from icounts), e as (select round, seq, substr(seq, cast(i as integer), 6) as k from x, unnest(range(1, 26)) as t(i)) select round, seq, count(distinct least(k, {_RC.format('k')})) as n from e group by round, seq")
def f09(spark, sf):
    from ..operators.counts import unique_counts

    return unique_counts(D.inserts(spark, sf)).select("round", "seq", F.size(S.canonical_kmers(F.col("seq"), 6)).cast("long").alias("n"))


@query("f10_core_places", f"with {D.READS} select round, cast(i as integer) as place, count(*) as n from reads, unnest(range(0, 40)) as t(i) where substr(seq, cast(i + 1 as integer), 10) = 'CACTATAGGG' group by all")
def f10(spark, sf):
    places = S.occurrences(F.substring("seq", 1, 49), "CACTATAGGG")
    return _reads(spark, sf).select("round", F.explode(places).alias("place")).groupBy("round", "place").agg(F.count(F.lit(1)).alias("n"))


@query("f11_overlapping_occurrences", f"with {D.INSERTS} select round, seq, cast(list_count(list_filter(range(1, 30), lambda i: substr(seq, i, 2) = 'AA')) as integer) as n from icounts")
def f11(spark, sf):
    from ..operators.counts import unique_counts

    return unique_counts(D.inserts(spark, sf)).select("round", "seq", F.size(S.occurrences(F.col("seq"), "AA")).alias("n"))


@query("f12_neighbourhood", f"with {D.READS} select round, count(*) filter ({_DIFFER.format(n=12, a='substr(seq, length(seq) - 11, 12)', b=repr(D.THREE[-12:]))} <= 1) as n from reads group by round")
def f12(spark, sf):
    end = F.substring("seq", F.length("seq") - 11, F.lit(12))
    return _reads(spark, sf).groupBy("round").agg(F.count_if(end.isin(S.neighbourhood(D.THREE[-12:]))).alias("n"))


@query("f13_edge_residue", f"with {D.READS}, p as (select unnest([6, 10, 14, 20]) as k) select round, k, count(*) filter (substr(seq, length(seq) - k + 1, k) = substr('{D.THREE}', 20 - k + 1, k)) as n from reads, p group by round, k")
def f13(spark, sf):
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.col("seq").endswith(D.THREE[-k:]).alias("hit")) for k in (6, 10, 14, 20)])
    return _reads(spark, sf).select("round", F.explode(ends).alias("e")).groupBy("round", "e.k").agg(F.count_if("e.hit").alias("n"))


@query("f15_barcode_strip", f"with {D.READS} select rec, case when starts_with(seq, 'ATTGT') then substr(seq, 6) when starts_with(seq, 'ATT') then substr(seq, 4) when starts_with(seq, 'AA') then substr(seq, 3) else seq end as seq from reads")
def f15(spark, sf):
    return _reads(spark, sf).select("rec", S.without_barcode(F.col("seq"), ["AA", "ATT", "ATTGT"]).alias("seq"))


@query("f20_clean_html", "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pages")
def f20(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", M.clean_html(F.col("html")).alias("text"))


@query("f21_multiplex_hint", f"select doc_id, regexp_matches(lower(concat_ws(' ', text, source)), '{'|'.join(M.MULTIPLEX)}') as hint from documents")
def f21(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", M.multiplex_hint(F.col("text"), F.col("source")).alias("hint"))


@query("f22_semicolon_list", "select page_id, cast(len(list_filter(list_transform(string_split(replace(url, '/', ';'), ';'), lambda x: trim(x)), lambda x: x <> '')) as integer) as n from pages")
def f22(spark, sf):
    n = F.size(M.semicolon_list(F.replace("url", F.lit("/"), F.lit(";"))))
    return D.table(spark, sf, "pages").select("page_id", F.when(F.col("url").isNotNull(), n).alias("n"))


@query("f23_safe_dir", "select page_id, replace(url, ':', '_') as dir from pages")
def f23(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", M.safe_dir(F.col("url")).alias("dir"))


@query("f24_round_label", "with x as (select unnest(['R0', 'r12', '7', 'round_03', 'Round5', 'pool', '']) as label) select label, try_cast(nullif(regexp_extract(label, '^(?:[Rr]|[Rr]ound_?)?([0-9]+)$', 1), '') as integer) as round from x")
def f24(spark, sf):
    x = spark.createDataFrame([(v,) for v in ("R0", "r12", "7", "round_03", "Round5", "pool", "")], "label string")
    return x.select("label", M.round_label(F.col("label")).alias("round"))


@query("f26_doi_normalise", "with x as (select page_id, concat('https://doi.org/10.1000/', cast(page_id as varchar), case when page_id % 2 = 0 then '.v2' else '' end, case when page_id % 3 = 0 then '.s001' else '' end) as doi from pages) select page_id, regexp_replace(regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:dx\\.)?(?:doi\\.org/|doi:)\\s*', ''), '(\\.[vgtsdef][0-9]+)+$', '') as doi from x")
def f26(spark, sf):
    p = F.col("page_id")
    doi = F.concat(F.lit("https://doi.org/10.1000/"), p.cast("string"), F.when(p % 2 == 0, ".v2").otherwise(""), F.when(p % 3 == 0, ".s001").otherwise(""))
    return D.table(spark, sf, "pages").select("page_id", M.normalised_doi(doi).alias("doi"))


@query("f27_repository_doi", "select page_id, starts_with(url, 'https://site1') or starts_with(url, 'http://') as known from pages")
def f27(spark, sf):
    u = F.col("url")
    return D.table(spark, sf, "pages").select("page_id", (u.startswith("https://site1") | u.startswith("http://")).alias("known"))


@query("f28_stated_length", "with x as (select doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '[0-9]+%', '', 'g'), '[0-9]+')) as n from documents) select doc_id, case when len(n) = 1 then n[1] end as stated from x")
def f28(spark, sf):
    n = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", "[0-9]+%", ""), F.lit("[0-9]+"), F.lit(0)))
    return D.table(spark, sf, "documents").select("doc_id", F.when(F.size(n) == 1, F.get(n, F.lit(0))).alias("stated"))


@query("f29_trajectory_key", f"with {D.RUNS} select srr, regexp_replace(sample_title, '^(.*)[0-9]+[^0-9]*$', '\\1') as trajectory from runs")
def f29(spark, sf):
    return D.runs(spark, sf).select("srr", F.regexp_replace("sample_title", "^(.*)[0-9]+[^0-9]*$", "$1").alias("trajectory"))


@query("f30_mean_read_length", "select o_orderkey, case when o_custkey % 5 = 0 then null else cast(o_orderkey as double) / (o_custkey % 5) end as mean_length from orders")
def f30(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.try_divide("o_orderkey", F.col("o_custkey") % 5).alias("mean_length"))


@query("f33_list_fingerprint", f"with {D.RUNS} select bioproject_id, sha256(string_agg(srr, '\n' order by srr)) as fingerprint from runs group by bioproject_id")
def f33(spark, sf):
    joined = F.array_join(F.array_sort(F.collect_list("srr")), "\n")
    return D.runs(spark, sf).groupBy("bioproject_id").agg(F.sha2(joined, 256).alias("fingerprint"))
