"""Toxicity: a weighted finite-state grammar over clauses, learnt from labelled rows.

Four transducers are composed. The lexicon reads letters and writes a word's class with a weight; it is a trie of whole words
and of word beginnings. Negation and reported speech read classes and write them again with a factor, smaller within
reach of a negation or after a reporting word. The pattern accepts a clause that joins an insult or a threat with a
target, in any order, and adds up the weights. The last three are tables of transitions, and ``compose`` makes one
table of them. An insult or threat without a target in its clause adds nothing, so no word is scored by itself. A text's
score is 1 - exp(-(sum over its matched clauses)), plus the small base of an empty text.

Built-in entries are plain English; the rest is learnt from a bounded sample of labelled rows, whatever its language.
Insults: words and beginnings of words (4 to 8 letters) that stand in toxic rows with many different left neighbours, and
hardly in others, with their log odds as weight; counting neighbours instead of rows keeps copies of one text from
teaching its words. Targets: words that share a clause with an insult in ``TARGET_ROWS`` toxic rows or more. Negations and
reporting words: words shortly before an insult, or elsewhere in its clause, that go with rows which are not toxic all the same.
On corpora of running prose the learnt targets are mainly the common words of a language, so there the grammar
asks little more than that an insult stands within a sentence; a bare word, a heading or a list of words has no target.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from .quality_classifier import in_fold, labelled_sample

SAMPLE = 10_000
#: Least number of different left neighbours in toxic rows, of such rows, and least log odds, of a learnt insult.
LEAST_SUPPORT, LEAST_ROWS, LEAST_ODDS = 6, 3, 2.5
BASE, SCALE = 0.02, 0.35
INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER = range(6)
#: Built-in words of the grammar, with the weights of insults and threats.
INSULTS = {"idiot": 5.0, "moron": 5.0, "stupid": 4.0, "loser": 4.0, "scum": 5.0, "pathetic": 4.0, "worthless": 4.0, "disgusting": 4.0}
THREATS = {"kill": 3.0, "hurt": 2.0, "destroy": 2.0, "beat": 1.5, "shoot": 2.5}
TARGETS = ("you", "your", "u", "he", "she", "they", "them", "him", "her", "people")
NEGATIONS = ("not", "never", "no", "isn", "aren", "wasn", "don", "won")
REPORTS = ("said", "says", "wrote", "called", "quoted", "according", "reported")
#: How many words a negation reaches, and what negation and reported speech leave of a weight.
REACH, NEGATED, QUOTED = 2, 0.3, 0.5
#: Least toxic rows in which a learnt target shares a clause with an insult; least rows that are not toxic for a learnt negation or report.
TARGET_ROWS, DENIAL_ROWS = 5, 5
_WORD = re.compile(r"[^\W\d_]+").finditer
_WORDS = re.compile(r"[^\W\d_]+").findall
_DELIMITERS = ".!?;:\n"
_CLAUSE = re.compile(f"[{_DELIMITERS}]")

#: Transducers over classes: {(state, class): (next state, class written, factor)}; what is not listed stays and writes what it reads.
Transducer = dict[tuple[str, int], tuple[str, int, float]]
NEGATING: Transducer = {("0", NEGATION): (str(REACH), NEGATION, 1.0)}
for _left in range(1, REACH + 1):
    NEGATING |= {(str(_left), c): (str(_left - 1), c, NEGATED if c in (INSULT, THREAT) else 1.0) for c in range(OTHER + 1)}
    NEGATING[str(_left), NEGATION] = (str(REACH), NEGATION, 1.0)
REPORTING: Transducer = {("0", REPORTED): ("said", REPORTED, 1.0), ("said", INSULT): ("said", INSULT, QUOTED), ("said", THREAT): ("said", THREAT, QUOTED)}
PATTERN: Transducer = {
    ("0", TARGET): ("target", TARGET, 1.0),
    ("0", INSULT): ("harm", INSULT, 1.0),
    ("0", THREAT): ("harm", THREAT, 1.0),
    ("harm", TARGET): ("match", TARGET, 1.0),
    ("target", INSULT): ("match", INSULT, 1.0),
    ("target", THREAT): ("match", THREAT, 1.0),
}


def compose(*parts: Transducer) -> dict[tuple[tuple[str, ...], int], tuple[tuple[str, ...], float]]:
    """One table of the parts in turn: {(states, class): (next states, factor)} for all states that can be reached."""
    start = ("0",) * len(parts)
    table, pending = {}, [start]
    seen = {start}
    while pending:
        states = pending.pop()
        for kind in range(OTHER + 1):
            now, factor, following = kind, 1.0, []
            for part, state in zip(parts, states, strict=True):
                state, now, f = part.get((state, now), (state, now, 1.0))
                following.append(state)
                factor *= f
            table[states, kind] = (tuple(following), factor if kind in (INSULT, THREAT) else 0.0)
            if tuple(following) not in seen:
                seen.add(tuple(following))
                pending.append(tuple(following))
    return table


class Lexicon:
    """Transducer from letters to (class, weight): a trie with final states for whole words and for beginnings."""

    def __init__(self, words: dict[str, tuple[int, float]], beginnings: dict[str, tuple[int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.word_out: dict[int, tuple[int, float]] = {}
        self.begin_out: dict[int, tuple[int, float]] = {}
        for entries, out in ((words, self.word_out), (beginnings, self.begin_out)):
            for entry, value in entries.items():
                out[self._state(entry)] = value

    def _state(self, entry: str) -> int:
        at = 0
        for c in entry:
            if c not in self.arcs[at]:
                self.arcs.append({})
                self.arcs[at][c] = len(self.arcs) - 1
            at = self.arcs[at][c]
        return at

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a word in lower case: the whole word if it is known, else its longest known beginning."""
        at, found = 0, (OTHER, 0.0)
        for c in word:
            at = self.arcs[at].get(c, -1)
            if at < 0:
                return found
            found = self.begin_out.get(at, found)
        return self.word_out.get(at, found)


_CLAUSES, _START = compose(NEGATING, REPORTING, PATTERN), ("0",) * 3


def clause_weight(classes: Iterator[tuple[int, float]]) -> float:
    """Weight of a clause by the composed transducer, 0 unless the pattern accepts it."""
    state, total = _START, 0.0
    for kind, weight in classes:
        state, factor = _CLAUSES[state, kind]
        total += factor * weight
    return total if state[-1] == "match" else 0.0


class Grammar:
    """The composed transducers, and an automaton that finds the clauses worth reading."""

    def __init__(self, words: dict[str, tuple[int, float]], beginnings: dict[str, tuple[int, float]]):
        import ahocorasick

        self.words, self.beginnings = words, beginnings
        self.lexicon = Lexicon(words, beginnings)
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for entry, (kind, _) in [*words.items(), *beginnings.items()]:
            if kind in (INSULT, THREAT):
                self.finder.add_word(entry)
        self.finder.make_automaton()
        self.any = len(self.finder) > 0

    def found(self, text: str) -> Iterator[tuple[str, int, int]]:
        """The text in lower case, and start and end of each clause with an insult or a threat."""
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        done = -1
        if self.any:
            for end, length in self.finder.iter(low):
                at = end + 1 - length
                if at <= done or (at and low[at - 1].isalpha()):
                    continue
                start = max(done, *(low.rfind(c, done + 1, at) for c in _DELIMITERS)) + 1
                stop = _CLAUSE.search(low, end + 1)
                done = stop.start() if stop else len(low)
                yield low, start, done

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in code points of each clause that the pattern accepts."""
        every = ((a, b, clause_weight(self.lexicon.read(m[0]) for m in _WORD(low, a, b))) for low, a, b in self.found(text))
        return [c for c in every if c[2] > 0]

    def score(self, text: str | None) -> float:
        mass = sum(w for _, _, w in self.clauses(text or ""))
        return 1 - (1 - BASE) * math.exp(-SCALE * mass)


def _built_in() -> dict[str, tuple[int, float]]:
    words = {w: (INSULT, x) for w, x in INSULTS.items()} | {w: (THREAT, x) for w, x in THREATS.items()}
    return words | {w: (kind, 0.0) for kind, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORTED, REPORTS)) for w in group}


@lru_cache(1 << 17)
def _entries(word: str) -> tuple[str, ...]:
    """A word and its beginnings, as lexicon entries."""
    return (word, *(word[:k] + "*" for k in range(4, min(8, len(word)) + 1)))


def learn_insults(rows: Iterable[tuple[str | None, int]]) -> Grammar:
    """The built-in grammar with insults learnt from (text, label) rows."""
    totals, negative = [0, 0], Counter()
    positive: dict[str, set[str]] = defaultdict(set)
    in_rows = Counter()
    for text, label in rows:
        totals[label] += 1
        words = _WORDS((text or "").lower())
        before = defaultdict(set)
        if label:
            for left, w in zip(["", *words], words, strict=False):
                before[w].add(left)
        seen = set()
        for w in set(words):
            entries = _entries(w)
            seen.update(entries)
            if label:
                for e in entries:
                    if len(positive[e]) < 64:
                        positive[e] |= before[w]
        (in_rows if label else negative).update(seen)
    words = _built_in()
    scored = []
    for e, neighbours in positive.items():
        if len(neighbours) >= LEAST_SUPPORT and in_rows[e] >= LEAST_ROWS:
            odds = math.log((in_rows[e] + 0.5) / (totals[1] + 1)) - math.log((negative[e] + 0.5) / (totals[0] + 1))
            share = in_rows[e] / max(1, totals[1])
            if odds >= LEAST_ODDS and share >= 0.005 and negative[e] <= 0.01 * in_rows[e] * totals[0] / max(1, totals[1]):
                scored.append((in_rows[e], not e.endswith("*"), len(e), e, odds))
    # The most frequent entries first, whole words before beginnings of the same rows; what an entry covers is left out.
    beginnings: dict[str, tuple[int, float]] = {}
    for _, whole, _, e, odds in sorted(scored, reverse=True):
        stem = e if whole else e[:-1]
        if any(stem[:k] in beginnings for k in range(4, len(stem) + 1)) or any(stem[:k] in words for k in range(3, len(stem) + 1)):
            continue
        (words if whole else beginnings)[stem] = (INSULT, min(8.0, odds))
    return Grammar(words, beginnings)


def learn(rows: Callable[[], Iterable[tuple[str | None, int]]]) -> Grammar:
    """The grammar learnt from two readings of the same (text, label) rows; without toxic rows, the built-in one."""
    grammar = learn_insults(rows())
    read = grammar.lexicon.read
    # By label: rows in which a word stands shortly before an insult, or elsewhere in the clause of one.
    near, around = (Counter(), Counter()), (Counter(), Counter())
    for text, label in rows():
        close, apart = set(), set()
        for low, a, b in grammar.found(text or ""):
            words = _WORDS(low[a:b])
            harm = [read(w)[0] in (INSULT, THREAT) for w in words]
            for i, w in enumerate(words):
                if not harm[i] and any(harm):
                    (close if any(harm[i + 1 : i + 1 + REACH]) else apart).add(w)
        near[label].update(close)
        around[label].update(close | apart)
    words = dict(grammar.words)
    for w in {*around[0], *around[1]}:
        if w in words or read(w)[0] != OTHER:
            continue
        if around[1][w] >= TARGET_ROWS and around[1][w] > around[0][w]:
            words[w] = (TARGET, 0.0)
        elif near[0][w] >= DENIAL_ROWS and near[0][w] > 4 * near[1][w]:
            words[w] = (NEGATION, 0.0)
        elif around[0][w] >= DENIAL_ROWS and around[0][w] > 4 * around[1][w]:
            words[w] = (REPORTED, 0.0)
    return Grammar(words, grammar.beginnings)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held_out: int = 1) -> Grammar:
    """The grammar learnt from at most ``sample`` labelled rows (label column toxic) outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", folds, held_out, sample // 2)
    return learn(lambda: ((r.text, r.label) for r in rows.toLocalIterator()))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score and clauses (spans and weights of matched clauses) for each row; a null text counts as empty."""
    import pyarrow as pa

    entries = docs.sparkSession.sparkContext.broadcast((grammar.words, grammar.beginnings))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*entries.value)
        for batch in batches:
            found = [own.clauses(t or "") for t in batch.column("text").to_pylist()]
            scores = [1 - (1 - BASE) * math.exp(-SCALE * sum(w for _, _, w in f)) for f in found]
            spans = pa.array([[{"start": a, "end": b, "weight": w} for a, b, w in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), spans], ["doc_id", "score", "clauses"])

    rows = only(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, clauses array<struct<start:bigint,end:bigint,weight:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; extra columns are never read.

    Empty and null texts score the base; an empty table gives an empty result. Repeated rows, ties and null ids are scored
    row by row (a null id is in no fold's held-out part). Texts are read whole and in linear time.
    """
    scored = score(docs, fit(docs, labels, sample, folds, held_out)).select("doc_id", "score")
    scored = stored(scored, "toxicity_scores")
    return scored.select("doc_id", in_fold(folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
