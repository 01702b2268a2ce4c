"""Helpers shared by the training-data operators: readers, batch sizes, hashes; and tables in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.staging import shared_dir, stage_table

__all__ = ["mix64", "shared_dir", "small_batches", "stage_table", "table", "texts"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Texts can be long: hand Python workers at most so many at once, so that their memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id long, text string, *others) of a documents-like table; null texts become empty, other columns go.
    Rows without a doc_id have no identity and are left out."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others
    ).where(F.col("doc_id").isNotNull())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, wrapping."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
