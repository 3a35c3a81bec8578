"""The stages of the corpus pipeline, each held against a plain version over the stage before it."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from poolforge.llm import pii, quality_rules, source_mix

from .conftest import passage
from .test_corpus_operators import PLAIN, brute_components, brute_spans

pytest.importorskip("public_tokenizers")


def staged(spark, frame, trusted, path):
    """Rows of the input and of each stage's result."""
    import corpus_pipeline

    frame.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    now = spark.read.parquet(str(path / "documents.parquet"))
    out = [now.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        following = stage(spark, now, str(path))
        following.write.parquet(str(path / f"stage{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert following.columns == now.columns
        now = spark.read.schema(following.schema).parquet(str(path / f"stage{i}"))
        out.append(now.collect())
    whole = corpus_pipeline.run(spark, str(path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, out[-1]))
    return out


def masked(text, terms=()):
    """Plain masking of the base spans, without terms."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in brute_spans(text):
        if a >= at:
            out += [text[at:a], f"[{list(PLAIN)[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_stages_over_awkward_rows(spark, rows, tmp_path):
    import tiktoken
    from public_tokenizers import PATTERN, path

    from poolforge.llm.byte_bpe import load_ranks

    long = [(700 + i, f"{passage(40 + i, 70)} mail a{i}@b.example or +1 499 555 650{i} now", "en", "src1", 0) for i in range(4)]
    twin = [(800, passage(61, 80), "en", "src0", 0), (800, passage(62, 80), "en", "src0", 0), (800, passage(62, 80), "en", "src0", 0)]
    other = [" ".join(w for k in range(72, -1, -12) for w in passage(61 + i, 80).split()[k : k + 12]) for i in range(2)]
    none = [(None, other[i // 2], "en", None if i < 2 else "src1", 0) for i in range(4)]
    frame = spark.createDataFrame([*rows, *long, *twin, *none], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("kept", "key", "size", "row", "words", "spans", "copies", "label", "__x"):
        frame = frame.withColumn(c, F.lit("extra"))
    trusted = [i for i, *_ in rows if i < 100] + [700, 701, 702, 703, 800]
    docs, good, single, clean, mixed, tokens = staged(spark, frame, trusted, tmp_path)

    judged = quality_rules.quality_rules(frame, spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    verdicts = Counter((r.doc_id, r.n_words) for r in judged.where("kept").collect())
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in good) == verdicts
    assert Counter(r.doc_id for r in good)[800] == 3 and Counter(r.doc_id for r in good)[None] == 4

    order = sorted(range(len(good)), key=lambda i: (good[i].doc_id is None, good[i].doc_id or 0))
    group = brute_components([(place, good[i].text) for place, i in enumerate(order)], 5)
    heads = [good[order[place]] for place, (_, c) in group.items() if place == c]
    assert Counter((r.doc_id, r.text) for r in single) == Counter((r.doc_id, r.text) for r in heads)
    assert Counter(r.doc_id for r in single)[800] == 2 and Counter(r.doc_id for r in single)[None] == 2

    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r in single)
    plain = Counter((r.doc_id, masked(r.text)) for r in single)
    free = {(r.doc_id, r.text) for r in clean if "[NAME]" not in r.text and "[WORD]" not in r.text}
    assert free <= set(plain) and len(free) > 0.8 * len(clean)
    shown = {r.doc_id: r.text for r in clean}
    for i, *_ in long:
        if i in shown:
            assert "[EMAIL]" in shown[i] and "[PHONE]" in shown[i] and "@" not in shown[i]

    before, after = Counter((r.doc_id, r.source, r.text) for r in clean), Counter((r.doc_id, r.source, r.text) for r in mixed)
    assert set(after) <= set(before) and all(n <= 3 * before[r] for r, n in after.items())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    for source, goal in source_mix.targets(dict(sizes)).items():
# No way to take whole documents is nearer than half of the longest.
        assert abs(taken[source] - goal) <= max(len(r.text.split()) for r in clean if r.source == source) / 2

    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expect = Counter()
    for r in mixed:
        ids = reference.encode_ordinary(r.text)
        expect[r.doc_id, r.source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in tokens) == expect


def test_stages_over_an_empty_table(spark, empty, tmp_path):
    assert [len(x) for x in staged(spark, empty, [], tmp_path)] == [0] * 6


def test_term_spans_equal_a_plain_version(spark):
    """A term is a word of a text with an entity that tells enough of the entity, by the counts of documents."""
    rng = random.Random(12)
    vocabulary = [passage(2000 + i, 1).capitalize() if i % 3 else passage(2000 + i, 1) + "xyzw" for i in range(60)]
    entities = [f"p{i}@mail.example" for i in range(6)] + ["+1 499 555 6503", "10.0.0.7"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary[: 10 + i % 50]) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            k = rng.randrange(2 + i % 7)
            words.insert(rng.randint(0, len(words)), entities[k])
            words += ["Zebulon" + "abcdefgh"[k]] * (k % 3)
        rows.append((i if i % 11 else None, " ".join(words) if i % 17 else None))
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "base", "spans", "term", "entity", "extra", "n_rows", "kind"):
        frame = frame.withColumn(c, F.lit("extra"))
    n, in_entity, in_term, in_both = len(rows), Counter(), Counter(), Counter()

    def parts(text):
        base = brute_spans(text)
        held = {(k, re.sub("[^0-9]", "", text[a:b]) if k >= 2 else text[a:b].lower()) for a, k, b in base}
        return base, held, {m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", text or "")}

    for _, text in rows:
        _, held, terms = parts(text)
        in_entity.update(held)
        in_term.update(terms)
        in_both.update((e, t) for e in held for t in terms)
    expect, count = Counter(), 0
    for i, text in rows:
        base, held, _ = parts(text)
        spans = list(base)
        for m in re.finditer(r"[^\W\d_]{4,}", text or ""):
            t = m[0].lower()
            told = any(in_entity[e] < n and math.log2(n * in_both[e, t] / (in_entity[e] * in_term[t])) >= pii.DISCLOSURE * math.log2(n / in_entity[e]) for e in held)
            if told and not any(a < m.end() and m.start() < b for a, _, b in base):
                spans.append((m.start(), 4, m.end()))
                count += 1
        expect[i, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))] += 1
    assert count > 5
    assert Counter((r.doc_id, r.spans) for r in pii.span_digests(pii.find_spans(frame)).collect()) == expect
    assert pii.sanitised(frame).count() == len(rows)
