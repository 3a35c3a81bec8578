r"""Personal data: fixed patterns, and terms that reveal it by co-occurrence in the corpus.

Base kinds are found by pattern: email, ip, card (Luhn) and phone. Their values are the protected entities. A term
(four letters or more) of a text that holds an entity is weighed by information theory: the entity's information is
IC = log2(N / df(entity)), and what a term tells of it is PMI = log2(N * df(both) / (df(entity) * df(term))), with frequencies of
whole documents over the whole corpus. Where a term tells at least ``DISCLOSURE`` of the information, reading it would give the
masked entity away, so every occurrence of it in the texts that hold the entity becomes a span of kind ``term``. The information
alone decides: an entity that stands in one text is weighed like any other, and a term like any other however far off it stands.
Sanitising masks base spans by kind and generalises terms to their kind of word.

DataFrame operations only. Positions come from the lengths of the pieces that split() leaves around the matches that
regexp_extract_all() returns, both by the same pattern. The patterns are the fixed ones with possessive repeats, and with
starts within a run of the same characters ruled out (a run that fails at its start fails everywhere), so that long runs
take linear time and no stack. Only texts that hold an entity are shuffled, once for all their copies, to find term spans; of
the others only terms and counts are. As df(both) <= df(entity), a term can reveal no entity that has df(term) > N * (df(entity) / N) **
DISCLOSURE; such terms are left out before they are paired with entities, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, only, stored

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}{4,}+"
DISCLOSURE = 0.9
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    def add(acc: Column, d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda acc, x: add(acc, x["d"], x["i"])) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _sums_before(sizes: Column) -> Column:
    """For each place the sum of the sizes before it; by blocks, as an array that grows by one is copied each time."""

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.size(sizes), F.lit(_BLOCK)), lambda b: running(F.slice(sizes, b + 1, _BLOCK)))

    def joined(inner: Column) -> Column:
        before = running(F.transform(inner, lambda x: F.element_at(x, -1)))
        return bind(before, lambda t: F.flatten(F.transform(inner, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + t[i]))))

    return bind(blocks, joined)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points."""

    def placed(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(gaps[i + 1]))

        def place(starts: Column) -> Column:
            at = lambda i: starts[i] + F.length(gaps[0])
            return F.transform(found, lambda m, i: F.struct(at(i).alias("start"), (at(i) + F.length(m)).alias("end"), m.alias("value")))

        return bind(bind(sizes, _sums_before), place)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps"))
    return bind(parts, placed)


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) of the valid base matches, by start, then kind."""

    def of(kind: str, t: Column) -> Column:
        some = F.contains(t, F.lit(HINTS[kind])) if kind in HINTS else t.rlike(PATTERNS[kind])
        spans = F.transform(
            F.filter(matches(t, PATTERNS[kind]), lambda m: _valid(kind, m["value"])),
            lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["value"].alias("value")),
        )
        return F.when(some, spans).otherwise(F.array()).cast(_SPANS)

    return bind(F.coalesce(text, F.lit("")), lambda t: F.sort_array(F.concat(*[of(k, t) for k in KINDS[:4]])))


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: F.lower(m)))


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """The spans of the given terms in a text, but those that overlap a base span."""

    def clear(m: Column) -> Column:
        return ~F.exists(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

    wanted = F.filter(matches(text, TERM), lambda m: F.array_contains(terms, F.lower(m["value"])))
    return F.transform(F.filter(wanted, clear), lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["end"].alias("end"), F.lower(m["value"]).alias("value")))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def find_spans(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, row (hash of the text) and spans, base and term spans by start, then kind, for each row of docs.

    A null text counts as empty. Rows that repeat an id or a text are judged alike, and each counts in the frequencies; extra
    columns are ignored. An empty table gives an empty result. Terms that overlap a base span are no spans of their own.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    held = bind(F.struct(base_spans(F.col("text")).alias("base"), F.col("text").alias("text")), lambda x: F.struct(x["base"].alias("base"), F.when(F.size(x["base"]) > 0, x["text"]).alias("text")))
    found = stored(rows.select("doc_id", "row", held.alias("x")).select("doc_id", "row", "x.base", "x.text"), "base_spans")
    # Each different text that holds an entity, once, with the number of rows that have it.
    texts = found.where("text is not null").groupBy("row").agg(F.first("base").alias("base"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n_rows"))
    texts = stored(texts, "entity_texts")
    entities = texts.select("row", "n_rows", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    per_entity = entities.groupBy("entity").agg(F.sum("n_rows").alias("n_entity"))
    entities = entities.join(per_entity, "entity")

    per_term = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    # No term of higher frequency reveals any entity of its text; 1.001 leaves room for rounding.
    most = entities.groupBy("row").agg(F.max("n_entity").alias("most"))
    words = texts.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(per_term, "term").join(most, "row")
    words = words.where(F.col("n_term") <= 1.001 * n * F.pow(F.col("most") / n, F.lit(disclosure))).select("row", "term", "n_term")
    pairs = stored(words.join(entities, "row"), "entity_terms")

    information = F.log2(n / F.col("n_entity"))
    told = F.log2(n * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_term")))
    weighed = pairs.groupBy("entity", "term").agg(F.sum("n_rows").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    revealing = weighed.where((information > 0) & (told >= disclosure * information)).select("entity", "term")

    chosen = pairs.join(revealing, ["entity", "term"]).groupBy("row").agg(F.collect_set("term").alias("terms"))
    extra = texts.join(chosen, "row").select("row", _term_spans(F.col("text"), F.col("base"), F.col("terms")).alias("extra"))
    joined = found.where("text is not null").select("doc_id", "row", "base").join(extra, "row", "left")
    spans = joined.select("doc_id", "row", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS)))).alias("spans"))
    return spans.unionByName(found.where("text is null").select("doc_id", "row", F.col("base").alias("spans")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with text sanitised: base spans become [EMAIL], [IP], [CARD] or [PHONE], terms [NAME] (capital first) or [WORD].

    Where spans overlap, the first one masks up to the last end. A null text stays null. All columns are kept; rows that
    share an id and a text are all kept.
    """
    spans = find_spans(docs, **options).groupBy("doc_id", "row").agg(F.max("spans").alias("__spans"))
    row = F.xxhash64(docs["text"])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["doc_id"]) & (row == spans["row"]), "left")

    def cleaned(text: Column, found: Column) -> Column:
        first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def add(acc: Column, s: Column) -> Column:
            upper = F.substring(text, s["start"] + 1, 1)
            word = F.when(F.lower(upper) != upper, "[NAME]").otherwise("[WORD]")
            mark = F.element_at(F.array(F.lit("[EMAIL]"), F.lit("[IP]"), F.lit("[CARD]"), F.lit("[PHONE]"), word), s["kind"] + 1)
            before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
            new = F.struct(F.concat(acc["out"], before, mark).alias("out"), s["end"].alias("at"))
            inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
            return F.when(s["start"] >= acc["at"], new).otherwise(inside)

        return F.aggregate(found, first, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    text = F.when(F.size("__spans") > 0, cleaned(docs["text"], F.col("__spans"))).otherwise(docs["text"])
    return joined.select(*[text.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])
