"""Toxicity scores from a learned lexicon, matched through Levenshtein automata on a trie.

Lexicon: from a bounded sample of labelled training rows (sample_per_class documents of each class, those with the
smallest hashes), Spark counts the documents of either class that hold each word and each word beginning; terms
are those that toxic documents hold far more often. The terms form a trie. Its product with the Levenshtein
automaton of `max_edits` edits is made deterministic state by state as words ask for it, so a word costs one table
step for each character, and most words die in a few; more than MAX_STATES states are forgotten. Each hit is weighed by its context window: quotation marks or
reporting words near it lower its weight, address and further terms near it raise it. A logistic model over these
features, fitted on the same sample, gives the score. Words, not labels, languages, sources or ids, enter a score.

Cases: null and empty texts get the score of a text without hits; documents without a label are scored like all
others; labels of unknown documents are ignored; with no training rows of a class nothing is learned and scores are
the base rate; repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stage_table, texts

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
QUOTES = "\"'«»“”„‘’‹›"
# fixed values: reporting words and words of address that the context window looks for
REPORTING = frozenset("said says quoted quote called wrote word words sagte dit dijo term".split())
ADDRESS = frozenset("you your youre du dich tu toi te vous usted".split())
WINDOW = 5
STEMS = range(4, 9)  # lengths of word beginnings that may be terms
MAX_STATES = 100_000  # of the automaton, in each worker


class TermAutomaton:
    """match(word) -> (weight, edits) of the best term within max_edits, or None. Terms: {text: (weight, is_stem)}; a
    stem matches words that begin with it. Short terms take no edits, stems neither: the whole words of a stem do."""

    def __init__(self, terms: dict[str, tuple[float, bool]], max_edits: int = 1, min_fuzzy: int = 5):
        self.max_edits = max_edits
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, bool, bool] | None] = [None]  # weight, is_stem, takes edits
        for term, (weight, is_stem) in sorted(terms.items()):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                node = self.next[node][c]
            self.ends[node] = (weight, is_stem, len(term) >= min_fuzzy and not is_stem)
        self.letters = {c for n in self.next for c in n}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[float, int] | None] = []
        self.stem: list[tuple[float, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        todo = list(items)
        best: dict[int, int] = {}
        while todo:  # skipping a letter of the term costs one edit
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.max_edits:
                todo += [(m, e + 1) for m in self.next[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(*self.ends[n], e) for n, e in key if self.ends[n]]
            self.found.append(max(((w, -e) for w, _, fuzzy, e in ends if not e or fuzzy), default=None))
            self.stem.append(max(((w, -e) for w, s, _, e in ends if s and not e), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.next[node]:
                out.add((self.next[node][c], e))
            if e < self.max_edits:
                out.add((node, e + 1))  # an added letter
                out |= {(m, e + 1) for m in self.next[node].values()}  # a changed letter
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[float, int] | None:
        if len(self.sets) > MAX_STATES:
            self._forget()
        state, best = self.start, None
        for c in word:
            if c not in self.letters:
                c = ""
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                return best
            state = to
            if self.stem[state]:
                best = max(best or self.stem[state], self.stem[state])
        return max(filter(None, (best, self.found[state])), default=None)


class _Matches(dict):
    """Cache from raw words (with their punctuation) to matches."""

    def __init__(self, automaton: TermAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, raw: str):
        got = self.automaton.match(EDGE.sub("", raw.lower()))
        if len(self) > 200_000:
            self.clear()
        self[raw] = got
        return got


FEATURES = ("exact", "edited", "strength", "near", "quoted", "density")


def features(text: str, matches: _Matches) -> list[float]:
    words = text.split()
    found = list(map(matches.__getitem__, words))
    hits = [k for k, m in enumerate(found) if m]
    if not hits:
        return [0.0] * len(FEATURES)
    strength = quoted = near = 0.0
    for k in hits:
        weight, edits = found[k]
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        plain = {EDGE.sub("", w.lower()) for w in around}
        marks = words[k][0] in QUOTES or any(w[0] in QUOTES for w in words[max(0, k - WINDOW) : k + 1]) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[k : k + 1 + WINDOW] if w.rstrip(".,;:!?"))
        part = 1.0 if edits == 0 else 0.8
        if marks or plain & REPORTING:
            quoted += 1
            part *= 0.25
        elif plain & ADDRESS or any(found[j] for j in range(max(0, k - WINDOW), min(len(words), k + 1 + WINDOW)) if j != k):
            near += 1
            part *= 1.2
        strength += weight * part
    edited = sum(found[k][1] < 0 for k in hits)
    return [float(edited < len(hits)), min(edited, 3) / 3, min(strength, 40.0) / 20, min(near, 4.0) / 2, quoted / len(hits), min(1.0, 20 * len(hits) / len(words))]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, toxic) of at most per_class training documents of each class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [usable.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(per_class) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")
    return texts(docs).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids


def learn_lexicon(sample: DataFrame, min_share: float = 0.02, min_docs: int = 4, enough_docs: int = 20, min_ratio: float = 20.0) -> dict[str, tuple[float, bool]]:
    """Terms and stems of toxic documents with their log odds. A term is held by min_share of the toxic documents,
    min_docs at least; enough_docs are enough at any size. Of documents with one text, that with the smallest id
    counts. Whole words stay terms beside their stem, since only they take edits. As many terms as a bounded sample has."""
    sample = sample.groupBy("toxic", F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    words = sample.select("doc_id", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("w"))
    stems = [F.when(F.length("w") > n, F.struct(F.substring("w", 1, n).alias("w"), F.lit(True).alias("stem"))) for n in STEMS]
    units = words.select("doc_id", "toxic", F.explode(F.array(F.struct("w", F.lit(False).alias("stem")), *stems)).alias("u"))
    counts = (
        units.where("u is not null").select("doc_id", "toxic", "u.w", "u.stem").distinct()
        .groupBy("w", "stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    )
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    odds = (F.col("t") + 0.1) / sizes[1] / ((F.col("c") + 0.1) / sizes[0])
    least = max(min_docs, min(enough_docs, int(min_share * sizes[1])))
    found = counts.where((F.col("t") >= least) & (odds >= min_ratio)).withColumn("odds", odds).collect()
    whole = {r["w"]: r for r in found if not r["stem"]}
    kept: dict[str, tuple[float, bool]] = {}
    held: dict[str, int] = {}
    for r in sorted((r for r in found if r["stem"]), key=lambda r: (-r["odds"], len(r["w"]), r["w"])):
        w = r["w"]
        inside = any(w.startswith(k) for k in kept)
        wider = any(k.startswith(w) and r["t"] <= 1.1 * held[k] for k in kept)
        alone = any(v.startswith(w) and r["t"] <= 1.1 * x["t"] for v, x in whole.items())  # one word's beginning
        if not (inside or wider or alone):
            kept[w], held[w] = (math.log(r["odds"]), True), r["t"]
    return {w: (math.log(r["odds"]), False) for w, r in whole.items() if w not in kept} | kept


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-2) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps on the penalised log likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + penalty * np.append(w[:-1], 0) / 10
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.eye(len(w)) * penalty / 10
        w = w - np.linalg.solve(hess, grad)
    return w


def scorer(docs: DataFrame, labels: DataFrame, max_edits: int = 1, sample_per_class: int = 4000):
    """A function from a text column to scores, learned from the training rows of docs and labels."""
    sample = stage_table(training_sample(docs, labels, sample_per_class), "sample")
    lexicon = learn_lexicon(sample)

    def feature_rows(batches):
        matches = _Matches(TermAutomaton(lexicon, max_edits))
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [features(t, matches) for t in pdf["text"]]})

    train = sample.select("toxic", "text").mapInPandas(feature_rows, "toxic int, x array<double>").toPandas()  # at most 2 * sample_per_class rows
    y = train["toxic"].to_numpy(float)
    x = np.stack(train["x"].to_numpy()) if len(train) else np.zeros((0, len(FEATURES)))
    model = fit_logistic(x, y) if len(y) else np.zeros(len(FEATURES) + 1)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matches = _Matches(TermAutomaton(lexicon, max_edits))
        for series in batches:
            x = np.array([[*features(t or "", matches), 1.0] for t in series]).reshape(len(series), len(model))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ model, -30, 30))))

    return F.pandas_udf(run, "double").asNondeterministic()  # computed once, however often it is named


def toxicity(docs: DataFrame, labels: DataFrame, max_edits: int = 1, sample_per_class: int = 4000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    score = scorer(docs, labels, max_edits, sample_per_class)
    scored = texts(docs).select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
