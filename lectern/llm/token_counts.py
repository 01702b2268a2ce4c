"""Token counts from flat, unindexed token files by a scan for the end-of-document id.

A token file is a run of fixed-width ids in which only the end-of-document id tells where a document ends. Files
are scanned in blocks: numpy finds the separators of a block at once, and a prefix scan over small per-block
sums (first within super-blocks, then over them, so that one huge file is no single sort group) stitches
documents that cross blocks.

Cases: an empty document is a separator alone (0 tokens); ids after the last separator of a file are returned
as one document with terminated = false; an empty file or table gives no rows; a null text counts as an empty one;
repeated rows are counted one by one; a text of any length is tokenised whole and its ids are cut into blocks; special tokens
that a text spells out are plain text here, so that only the separator separates; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_bpe
from lectern.llm.common import stage_table, texts

STORE = "kind string, file long, seq long, payload binary"
SCANNED = "file long, block long, n_tokens long, n_eos long, ends array<int>"
SUPER = 256  # blocks in a super-block


def write_token_store(docs: DataFrame, eos: int = 50256, block_tokens: int = 1 << 16, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokenise documents into one flat uint16 stream for each input partition, in blocks of block_tokens ids.
    Rows of kind `tokens` are the stream, cut without regard to documents; rows of kind `names` hold the ids of
    the documents in stream order (seq = ordinal of the first), which the scan itself does not need."""

    def run(batches):
        bpe, end, size = byte_bpe(tokenizer, 2), np.array([eos], "<u2").tobytes(), 2 * block_tokens
        file, buffer, block, names, first = TaskContext.get().partitionId(), bytearray(), 0, [], 0
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                buffer += bpe.encode_bytes(text) + end
                names.append(doc_id)
                if len(buffer) >= size:
                    whole = len(buffer) // size * size
                    for s in range(0, whole, size):
                        out.append(("tokens", file, block, bytes(buffer[s : s + size])))
                        block += 1
                    del buffer[:whole]
            if len(names) >= 8192:
                out.append(("names", file, first, np.array(names, "<i8").tobytes()))
                first, names = first + len(names), []
            yield pd.DataFrame(out, columns=["kind", "file", "seq", "payload"])
        out = [("tokens", file, block, bytes(buffer))] * bool(buffer)
        out += [("names", file, first, np.array(names, "<i8").tobytes())] * bool(names)
        yield pd.DataFrame(out, columns=["kind", "file", "seq", "payload"])

    return stage_table(texts(docs).mapInPandas(run, STORE), "tokens")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, seq, payload) blocks of binary token files in any store that Spark reads. Files are numbered by
    path; one file is one row of Spark's binary source, so files must stay below its limit of 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    size = width * block_tokens

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                cuts = range(0, len(content), size)
                yield pd.DataFrame({"path": file, "seq": range(len(cuts)), "payload": [content[s : s + size] for s in cuts]})

    # an id from the path itself: no global sort of files
    blocks = files.select("path", "content").mapInPandas(run, "path string, seq long, payload binary")
    return blocks.select(F.xxhash64("path").alias("file"), "seq", "payload", "path")


def separator_scan(blocks: DataFrame, eos: int, width: int = 2) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in blocks (file, seq, payload)."""

    def scan(batches):
        for pdf in batches:
            ids = [np.frombuffer(p, f"<u{width}") for p in pdf["payload"]]
            ends = [np.flatnonzero(x == eos).astype("i4") for x in ids]
            yield pd.DataFrame({"file": pdf["file"], "block": pdf["seq"], "n_tokens": [len(x) for x in ids], "n_eos": [len(x) for x in ends], "ends": ends})

    scanned = stage_table(blocks.select("file", "seq", "payload").mapInPandas(scan, SCANNED), "scan")
    scanned = scanned.withColumn("part", F.floor(F.col("block") / SUPER))
    prior = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        scanned.withColumn("last_end", F.when(F.col("n_eos") > 0, F.array_max("ends")))
        .select("file", "part", "block", "n_tokens", "n_eos", "last_end")
    )
    inner = prior("file", "part").orderBy("block")
    inside = (
        sums.withColumn("tok_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .withColumn("eos_in", F.coalesce(F.sum("n_eos").over(inner), F.lit(0)))
        .withColumn("open_in", F.last(F.col("tok_in") + F.col("last_end") + 1, ignorenulls=True).over(inner))
    )
    outer = prior("file").orderBy("part")
    parts = (
        inside.groupBy("file", "part")
        .agg(F.sum("n_tokens").alias("t"), F.sum("n_eos").alias("e"), F.max(F.col("tok_in") + F.col("last_end") + 1).alias("o"))
        .withColumn("tok_out", F.coalesce(F.sum("t").over(outer), F.lit(0)))
        .withColumn("eos_out", F.coalesce(F.sum("e").over(outer), F.lit(0)))
        .withColumn("open_out", F.last(F.col("tok_out") + F.col("o"), ignorenulls=True).over(outer))
    )
    placed = inside.join(parts, ["file", "part"]).select(
        "file", "block",
        (F.col("tok_out") + F.col("tok_in")).alias("base"),
        (F.col("eos_out") + F.col("eos_in")).alias("rank"),
        F.coalesce(F.col("tok_out") + F.col("open_in"), F.col("open_out"), F.lit(0)).alias("open"),
    )
    both = scanned.where("n_eos > 0").select("file", "block", "ends").join(placed, ["file", "block"])
    # a document starts after the separator before it: in this block, or the last one of an earlier block
    ends = F.transform("ends", lambda e: F.col("base") + e)
    starts = F.concat(F.array("open"), F.transform(F.slice(ends, 1, F.size("ends") - 1), lambda e: e + 1))
    whole = (
        both.select("file", "rank", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("i", "x"))
        .select("file", (F.col("rank") + F.col("i")).alias("ordinal"), F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("n_tokens"), F.lit(True).alias("terminated"))
    )
    tail = (
        parts.groupBy("file").agg(F.sum("t").alias("t"), F.sum("e").alias("ordinal"), F.coalesce(F.max(F.col("tok_out") + F.col("o")), F.lit(0)).alias("start"))
        .where("t > start").select("file", "ordinal", "start", (F.col("t") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    )
    return whole.unionByName(tail)


def document_names(store: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of a store's documents."""

    def run(batches):
        for pdf in batches:
            for file, first, raw in zip(pdf["file"], pdf["seq"], pdf["payload"], strict=True):
                ids = np.frombuffer(raw, "<i8")
                yield pd.DataFrame({"file": file, "ordinal": np.arange(first, first + len(ids)), "doc_id": ids})

    return store.where("kind = 'names'").select("file", "seq", "payload").mapInPandas(run, "file long, ordinal long, doc_id long")


def token_counts(docs: DataFrame, eos: int = 50256, block_tokens: int = 1 << 16) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): documents to flat token files, counts from the scan alone."""
    store = write_token_store(docs, eos, block_tokens)
    spans = separator_scan(store.where("kind = 'tokens'"), eos)
    return document_names(store).join(spans, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
