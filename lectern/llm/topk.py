"""Exact top-k inner-product search by term-at-a-time accumulation.

Rows are sparse integer vectors. A grid of (row group, query block) cells is laid over the work: each row goes to
one row group, each query to one query block, and copies meet in the cell of both. In a cell the rows become
postings (for each dimension: the rows that hold it and their weights); each query's dimensions are taken one at a
time and scatter weight times posting into a dense score array over the cell's rows; a partition selection keeps k.
The cells' winners, k for each query and cell, are merged by a window. A cell's size is set in bytes: its score
matrix of rows and its queries hold at most cell_bytes each, in the mean, whatever the input's size and the vectors' width
(and at most rows_per_group rows and queries_per_block queries).

Cases: null vectors and vectors with a null or non-finite component take no part; vectors of unequal length
count as zero beyond their end; a row that repeats a vec_id with the same vector counts once; different vectors under one
vec_id are one candidate, and one query, with the greatest score of any pair of vectors; a null vec_id takes no part; with fewer rows than k, all are returned; an empty table gives an empty result. Components must stay within
the integers that a product sum in 64 bits holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, without unusable vectors."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
        .select("vec_id", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))
    )


def _cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    own = pdf["is_query"].to_numpy()
    rows, queries = pdf[~own], pdf[own]
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], rows["v"].to_numpy()[order]
    if not len(ids) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = max(len(v) for v in vectors)
    dense = np.zeros((width, len(ids)), np.int64)
    for j, v in enumerate(vectors):
        dense[: len(v), j] = v
    postings = []
    for row in dense:
        at = np.flatnonzero(row)
        postings.append((slice(None), row) if len(at) == len(ids) else (at, row[at]))
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # of the rows that share an id
    several, ids = len(first) < len(ids), ids[first]
    out = []
    for query_id, own_vectors in queries.groupby("vec_id")["v"]:
        best = None
        for q in own_vectors:
            score = np.zeros(len(vectors), np.int64)
            q = np.asarray(q)[:width]
            for d in np.flatnonzero(q):
                at, weights = postings[d]
                score[at] += q[d] * weights
            best = score if best is None else np.maximum(best, score)
        if several:
            best = np.maximum.reduceat(best, first)
        allowed = np.flatnonzero(ids != query_id)
        s = best[allowed]
        if len(s) > k:  # all above the k-th score, then ties by smaller id (ids are in order)
            kth = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > kth)
            ties = np.flatnonzero(s == kth)[: k - len(above)]
            take = np.concatenate([above, ties])
        else:
            take = np.arange(len(s))
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[allowed[take]], "score": s[take]}))
    return pd.concat(out)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, rows_per_group: int = 131_072, queries_per_block: int = 4096, min_groups: int = 24, cell_bytes: int = 1 << 26) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, its k best other rows; ties to smaller vec_id.
    vectors: (vec_id long, v array<long>)."""
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    fit = max(1, cell_bytes // (8 * max(1, sizes["width"] or 0)))
    groups = max(min_groups, -(-sizes["n"] // min(fit, rows_per_group)))
    blocks = max(1, -(-sizes["q"] // min(fit, queries_per_block)))
    vectors = vectors.select("vec_id", "v", is_query.alias("is_query")).dropDuplicates(["vec_id", "v"])
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))
    rows = vectors.select(group.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), "vec_id", "v", F.lit(False).alias("is_query"))
    asked = vectors.where("is_query").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), block.alias("b"), "vec_id", "v", F.lit(True).alias("is_query"))
    hits = rows.unionByName(asked).groupBy("g", "b").applyInPandas(lambda pdf: _cell(pdf, k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
