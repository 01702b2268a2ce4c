"""Quality rules, with repetition found by suffix arrays over words.

Each Arrow batch is cut into groups of whole documents, whose words become numbers. A suffix array over the group is
built by prefix doubling in which only suffixes that still tie go on (document and word form the first key, so that
matches never leave a document). Longest common prefixes of neighbours come from the kept rank levels; the LCP
intervals of at least `window` words are the maximal repeated substrings. Their spans are united: the verdict limits
the covered share of a document's words and its longest repeat. No shuffle: a document is judged on its own.

Cases: null and empty texts have no words and fail; words are split at the six ASCII white-space characters only;
repeated rows are judged one by one; a text of any length is judged whole, in memory of some 150 bytes a word, or of
4 bytes a word for each doubling if the text repeats itself throughout; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, texts

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
GROUP_WORDS = 200_000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths) of repeats of at least `window` words. words: a number for each word; doc: its document;
    ends: for each word the end of its document. Each place that begins a repeat has its longest one."""
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: where a suffix's group begins
    rank = np.empty(n, np.int32)  # a rank level for each doubling
    rank[order] = start
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = order[np.repeat(size > 1, size)]
    levels, reach, lasting = [rank], 1, None
    while len(tied):
        ahead = tied + reach
        second = np.where(ahead < ends[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        old = rank[tied]
        fresh, head = np.ones(len(tied), bool), np.ones(len(tied), bool)
        head[1:] = old[1:] != old[:-1]
        fresh[1:] = head[1:] | (second[1:] != second[:-1])
        at = np.arange(len(tied))
        moved = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[tied] = old + moved
        size = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        reach *= 2
        levels.append(rank)
        if reach <= window:
            lasting = tied  # those that share at least `reach` words with another
    if reach <= window or lasting is None or not len(lasting):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lasting = lasting[np.argsort(rank[lasting])]
    i, j = lasting[:-1], lasting[1:]
    common = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i + common, j + common
        inside = (a < ends[i]) & (b < ends[j])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common += same * (1 << k)
    best = np.zeros(len(lasting), np.int64)
    best[:-1] = common
    best[1:] = np.maximum(best[1:], common)
    long = best >= window
    return lasting[long], best[long]


def covered(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Marks of the words that the union of the spans covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + lengths, -1)
    return np.cumsum(step)[:n] > 0


def measure(rows: list[str], window: int = 8) -> list[tuple[int, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in rows]
    number: dict[bytes, int] = {}
    size = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(size.sum()))
    ends = np.repeat(np.cumsum(size), size)
    doc = np.repeat(np.arange(len(rows)), size)
    places, lengths = repeats(ids, doc, ends, window) if len(ids) else (np.empty(0, np.int64),) * 2
    repeated = np.bincount(doc, covered(places, lengths, len(ids)), len(rows)) if len(places) else np.zeros(len(rows))
    longest = np.zeros(len(rows), np.int64)
    np.maximum.at(longest, doc[places] if len(places) else places, lengths)
    out = []
    for k, text in enumerate(rows):
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        out.append((
            int(size[k]), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), int(repeated[k]), int(longest[k]),
        ))
    return out


def measures(window: int = 8):
    """A function from a text column to its measures, as a struct."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = series.fillna("").tolist()
            bound = np.cumsum([len(t) // 6 + 1 for t in rows]) // GROUP_WORDS
            parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(bound)) + 1)
            found = [x for part in parts for x in measure([rows[k] for k in part], window)]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in MEASURES.split(", ")])

    return F.pandas_udf(run, MEASURES).asNondeterministic()  # computed once, however often it is named


def with_verdict(docs: DataFrame, window: int = 8, min_words: int = 20, base_share: int = 30, max_share: int = 20, max_repeat: int = 100) -> DataFrame:
    """docs with `quality`: a struct of the measures, base_failed and kept. Shares are per cent of the words; max_repeat
    is in words."""
    small_batches(docs.sparkSession)
    m = lambda name: F.col("_m")[name]
    failed = (m("n_words") < min_words) | (100 * m("n_repeat_words") > base_share * m("n_words"))
    repeats_much = (100 * m("n_repeat_words") > max_share * m("n_words")) | (m("longest_repeat") > max_repeat)
    fields = [m(x.split()[0]).alias(x.split()[0]) for x in MEASURES.split(", ")]
    verdict = F.struct(*fields, failed.alias("base_failed"), (~failed & ~repeats_much).alias("kept"))
    return docs.withColumn("_m", measures(window)(F.col("text"))).withColumn("quality", verdict).drop("_m")


def quality_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """One row for each document: doc_id, the measures, base_failed and kept."""
    return with_verdict(texts(docs), **limits).select("doc_id", "quality.*")
