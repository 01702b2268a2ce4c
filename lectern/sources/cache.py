"""Tables of model results that are added to exactly once.

A run writes its rows under its own name, run=<run_id>. Written again, by a retried task or job, the run replaces its
own rows and adds none; Spark moves finished files into place at the end of a job, so a run that fails adds nothing. Keys
that another run has added before are refused.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources.staging import stage_table


def read_cache(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], other_than: str | None = None) -> DataFrame:
    """The table at path, one row for each key: that of the first run by name, should two runs at the same time have
    added it. Empty where nothing was written yet. other_than: without the rows of this run."""
    names = StructType.fromDDL(schema).fieldNames()
    try:
        rows = spark.read.schema(f"{schema}, run string").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if other_than is not None:
        rows = rows.where(F.col("run") != other_than)
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("run", *names)).alias("r"))
    return first.select("r.*")


def append_once(df: DataFrame, path: str, run_id: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Add df's rows to the table at path as run run_id. Returns one row (appended, refused): refused are rows whose key
    another run has, and further rows of one key, of which the least stays. Null keys are refused, too."""
    spark = df.sparkSession
    names = StructType.fromDDL(schema).fieldNames()
    given = stage_table(df.select(*names), "given")
    own = given.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(F.struct(*names)).alias("r")).select("r.*")
    before = read_cache(spark, path, schema, keys, other_than=run_id).select(*keys)
    new = stage_table(own.join(before, list(keys), "left_anti"), "new")
    if not new.isEmpty():
        new.withColumn("run", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    appended = new.agg(F.count("*").alias("appended"))
    return given.agg(F.count("*").alias("n")).join(appended, how="cross").select("appended", (F.col("n") - F.col("appended")).alias("refused"))  # one row each
