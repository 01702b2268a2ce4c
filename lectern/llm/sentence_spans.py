"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and these into clauses (at a line feed, at the blank after one of `.!?,;:`, and at the
stops of scripts without blanks), so that a passage copied into the middle of a long sentence still holds whole units.
Every run of `span` consecutive units with at least `min_words` words is hashed to 95 bits, from 128 bits of each unit;
runs are grouped over all documents with map-side sums, and every unit that a run covers goes unless that run is its
first occurrence, by (doc_id, position). A run that a third of all documents hold is one row for each map task in the
grouping, and the join that brings verdicts back is of two plain exchanges, which Spark splits where they are skewed.

`n_clauses` and `n_removed` count units; `n_sentences` counts those that end a sentence, that is, neither end in one of
`,;:` or their like nor go on. Two ideographs or kana count as a word.

Cases: null and empty texts have no units and stay empty; texts with fewer than `span` units are kept whole; units are
compared without blanks, tabs and carriage returns at their ends; a very long text takes some 20 times its size; rows
that repeat a doc_id count as the same document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mix64, stage_table, texts

MARKS = ".!?,;:"  # before a blank
WIDE_MARKS = "。！？，；：、"
GOES_ON = tuple(",;:，；：、")
IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")
BREAK = "\ud800"  # no text in UTF-8 holds it
RUNS = "h long, g int, doc_id long, pos int"
RESULT = "doc_id long, kept string, n_sentences long, n_clauses long, n_removed long"


def pieces(text: str) -> list[str]:
    """The text cut after each sentence and clause end; joined, it is the text again."""
    for end in ("\n", *(mark + " " for mark in MARKS), *("" if text.isascii() else WIDE_MARKS)):
        text = text.replace(end, end + BREAK)
    return text.split(BREAK)


def units(text: str) -> tuple[list[str], list[int], list[str]]:
    """pieces(text), the places in it of its units, and these without blanks around them."""
    parts = pieces(text)
    found = [(k, s) for k, s in enumerate(x.strip(" \t\r\n") for x in parts) if s]
    return parts, [k for k, _ in found], [s for _, s in found]


def n_words(unit: str) -> int:
    return unit.count(" ") + 1 + (0 if unit.isascii() else len(IDEOGRAPH.findall(unit)) // 2)


def n_ends(found: list[str]) -> int:
    """How many units end a sentence."""
    return sum(not s.endswith(GOES_ON) for s in found[:-1]) + bool(found)


def run_hashes(found: list[str], span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs that count, and their keys (two columns: 64 bits and 31 bits)."""
    n = len(found) - span + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty((0, 2), np.int64)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), ">u8").astype(np.uint64).reshape(-1, 2)
    words = np.cumsum([0, *map(n_words, found)])
    h, g = np.full(n, np.uint64(span)), np.zeros(n, np.uint64)
    for k in range(span):
        h, g = mix64(h + each[k : k + n, 0]), mix64(g + each[k : k + n, 1])  # from both halves of a unit's 128 bits
    pos = np.flatnonzero(words[span:] - words[:-span] >= min_words)
    return pos, np.stack([h.view(np.int64), (g >> np.uint64(33)).astype(np.int64)], 1)[pos]


def span_dedup(docs: DataFrame, span: int = 3, min_words: int = 8) -> DataFrame:
    """(doc_id, kept, n_sentences, n_clauses, n_removed): each text without the units of repeated runs."""
    docs = texts(docs)

    def hashed(batches):
        for pdf in batches:
            ids, at, keys = [], [], []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                pos, key = run_hashes(units(text)[2], span, min_words)
                ids.append(np.full(len(pos), doc_id, np.int64))
                at.append(pos)
                keys.append(key)
            keys = np.concatenate(keys) if keys else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"h": keys[:, 0], "g": keys[:, 1], "doc_id": np.concatenate(ids or [[]]), "pos": np.concatenate(at or [[]])})

    runs = docs.mapInPandas(hashed, RUNS)
    repeated = stage_table(
        runs.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first"),
        "runs",
    )
    later = runs.join(repeated, ["h", "g"]).where("doc_id > first")
    flags = later.groupBy("doc_id").agg(F.collect_list("pos").alias("later"))  # as many as a document has runs

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, flagged in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["later"], strict=True):
                parts, places, found = units(text)
                pos, key = run_hashes(found, span, min_words)
                gone = np.zeros(len(found) + 1, np.int64)
                again = np.ones(len(pos), bool)  # a run's later places within its own document
                again[np.unique(key, axis=0, return_index=True)[1]] = False
                starts = pos[again] if flagged is None else np.unique(np.concatenate([pos[again], np.asarray(flagged, np.int64)]))
                for k in range(span):
                    gone[starts + k] = 1
                kept = text
                if n := int(gone.sum()):
                    drop = {places[k] for k in np.flatnonzero(gone)}
                    kept = "".join(part for k, part in enumerate(parts) if k not in drop)
                rows.append((doc_id, kept, n_ends(found), len(found), n))
            yield pd.DataFrame(rows, columns=["doc_id", "kept", "n_sentences", "n_clauses", "n_removed"])

    return docs.join(flags, "doc_id", "left").select("doc_id", "text", "later").mapInPandas(cut, RESULT)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_sentences", "n_clauses", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
