"""Best-fit packing of tokenised documents into sequences of a fixed length, bulk-synchronous.

Pieces are range-sorted once, the longest first. They are packed in bands of falling length: BANDS names for each band
how many of its pieces surely fit into one sequence. A superstep takes the next band,

1. range-sorts the gaps of all open sequences as slots: a gap of room r is r // w slots of the band's longest length w
   and, if a piece can go there, one of the rest;
2. sweeps: the successor of a piece is the first slot that is not smaller. The longest pieces that can all be placed
   take part, and each takes the first slot from its successor on that pieces before it leave free: its own rank plus
   the largest lead of a successor over a rank so far. So ranks settle all conflicts, and no slot is claimed twice;
3. joins pieces and slots on the slot's rank; what no slot takes opens new sequences; what was placed is taken from
   the gaps. The next band goes on with these.

Ranks, matches and gaps are distributed; only how many pieces and slots there are of each length (at most max_len
numbers) comes to the driver, which takes the sweep's running sums over them. The number of supersteps depends on
max_len, not on the number of documents.

Cases: null text is an empty document (one end token); an empty table gives an empty result; repeated rows are
packed as often as they occur, and may share a doc_id; a text is tokenised whole, so a task holds some 20 bytes for each of
its characters; special tokens of the vocabulary that a text spells out become their ids; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_bpe
from lectern.llm.common import stage_table, texts
from lectern.sources.staging import with_dense_id

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BANDS = (1, 2, 3, 4, 6, 8, 16, 32)  # pieces of a band that surely fit into one sequence


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only longer ones are cut, and only the first may be shorter."""
    first = n if n <= max_len else n % max_len or max_len
    return [(0, first), *((s, max_len) for s in range(first, n, max_len))]


def token_pieces(docs: DataFrame, max_len: int = 1024, eos: int = 2, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row for each piece of each document; tokens stay in the task."""

    def run(batches):
        bpe, end = byte_bpe(tokenizer, 4, special=True), np.array([eos], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                ids = bpe.encode_bytes(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, max_len)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInPandas(run, PIECES)


def sweep(waiting: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pieces of each length are placed, and the slot of the first of them. waiting[n], slots[n]: pieces and
    slots of length n; slots are numbered from the smallest on, and a length's pieces take one after another."""
    fit = np.cumsum(slots[::-1])  # slots for pieces of this length or more, from the longest on
    want = np.cumsum(waiting[::-1])
    done = np.minimum(want + np.minimum.accumulate(np.minimum(fit - want, 0)), fit)
    placed = np.diff(np.append(0, done))[::-1]
    ahead = np.cumsum(slots) - slots  # smaller slots
    rank = np.cumsum(placed) - placed
    lead = np.where(placed > 0, ahead - rank, 0)
    return placed, rank + np.maximum.accumulate(lead)


def by_length(rows: DataFrame, column: str, most: int) -> np.ndarray:
    """How many rows there are of each length."""
    out = np.zeros(most + 1, np.int64)
    for r in rows.groupBy(column).count().collect():  # at most `most` rows
        out[r[0]] = r[1]
    return out


def best_fit(pieces: DataFrame, max_len: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with doc_id, piece and length (1 to max_len)."""
    spark = pieces.sparkSession
    columns = pieces.columns
    ranked = with_dense_id(pieces, [F.desc("length"), *(c for c in columns if c != "length")], "rank")
    ranked = stage_table(ranked, "ranked")
    counts = by_length(ranked, "length", max_len)
    rank = np.cumsum(counts[::-1])[::-1] - counts  # of the first piece of a length
    gaps = stage_table(spark.createDataFrame([], "sequence_id long, room int"), "gaps")
    rooms, sequences, placed = np.zeros(max_len + 1, np.int64), 0, []

    def of_length(values: np.ndarray) -> Column:
        """values[length], as a constant of the plan: max_len + 1 numbers."""
        return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<long>")[F.col("length").cast("int")]

    def of_plan(number: np.ndarray, since: np.ndarray, first: np.ndarray) -> DataFrame:
        """number[n] pieces of each length from rank since[n] on, with `at`: first[n] and so on."""
        use = np.flatnonzero(number)
        some = ranked.where(F.col("rank").between(int(since[use].min()), int((since + number)[use].max())))
        some = some.where((F.col("rank") >= of_length(since)) & (F.col("rank") < of_length(since + number)))
        return some.select(*columns, (F.col("rank") + of_length(first - since)).alias("at"))

    bands = [k for k in BANDS if k < max_len] + [max_len]
    for step, (k, after) in enumerate(zip(bands, [*bands[1:], 0], strict=True)):
        longest, below = max_len // k, max_len // after if after else 0
        number = np.zeros(max_len + 1, np.int64)
        number[below + 1 : longest + 1] = counts[below + 1 : longest + 1]
        if not number.any():
            continue
        size = np.arange(max_len + 1)
        slots = np.bincount(size % longest, rooms * (size % longest > below), max_len + 1).astype(np.int64)
        slots[longest] += int((size // longest * rooms).sum())
        fits, first = sweep(number, slots)
        left, rows = number - fits, []
        opened = -(-int(left.sum()) // k)
        if fits.any():
            spare = F.array_repeat(F.lit(longest), (F.col("room") / longest).cast("int"))
            last = F.when(F.col("room") % longest > below, F.array((F.col("room") % longest).cast("int"))).otherwise(F.array().cast("array<int>"))
            slot = gaps.where(F.col("room") > below).select("sequence_id", F.posexplode(F.concat(spare, last)).alias("slot", "size"))
            slot = with_dense_id(slot, ["size", "sequence_id", "slot"], "at").select("at", "sequence_id", "slot")
            rows.append(of_plan(fits, rank, first).join(slot, "at").drop("at"))
        if opened:
            first = np.cumsum(left[::-1])[::-1] - left  # the longest first
            at = F.col("at")
            rows.append(of_plan(left, rank + fits, first).select(*columns, (sequences + F.floor(at / k)).alias("sequence_id"), (at % k).cast("int").alias("slot")))
        placed.append(stage_table(reduce(DataFrame.unionByName, rows).withColumn("step", F.lit(step)), "placed"))
        used = placed[-1].groupBy("sequence_id").agg(F.sum("length").cast("int").alias("used"))
        every = gaps.unionByName(spark.range(sequences, sequences + opened).select(F.col("id").alias("sequence_id"), F.lit(max_len).alias("room")))
        every = every.join(used, "sequence_id", "left").select("sequence_id", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        gaps = stage_table(every.where("room > 0"), "gaps")
        rooms, sequences = by_length(gaps, "room", max_len), sequences + opened
    if not placed:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = Window.partitionBy("sequence_id").orderBy("step", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))  # over at most max_len pieces
    return reduce(DataFrame.unionByName, placed).select(*columns, "sequence_id", offset.alias("offset"))


def pack_documents(docs: DataFrame, max_len: int = 1024, eos: int = 2, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokenise, cut and pack whole documents; one row for each piece."""
    return best_fit(stage_table(token_pieces(docs, max_len, eos, tokenizer), "pieces"), max_len)
