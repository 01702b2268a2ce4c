"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests), one temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return _own[0]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_dense_id(df: DataFrame, keys: list, name: str, first: int = 0) -> DataFrame:
    """Adds a dense number in the order of keys: rows are range-sorted, a partition's rows are numbered in place, and
    the sizes of the partitions before it are added. No single task sees all rows."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage_table(placed.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name)
    sizes = placed.groupBy("_part").count()  # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + first).alias(name))
