"""The corpus pipeline: quality rules, toxicity, near-dedup, suffix-array dedup and packing, one after another.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame with the columns of documents (the last: one row for each packed piece). run() writes each
stage's result to the shared folder and reads it again as the next one's docs.

Cases: null texts count as empty ones and go in the first stage, as do all texts of fewer than 20 words; rows without a
doc_id go in the third; of rows that repeat a doc_id and a text one stays there, and of rows that repeat a doc_id with
different texts each is judged by itself, so that a doc_id may stay twice; ties go to the smaller doc_id; lang, source and
n_chars may be null, and are taken along; long texts are taken whole by every stage; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import ship
from lectern.llm import lsh_forest, packing, quality, suffix_dedup, toxicity
from lectern.llm.common import stage_table, table
from lectern.sources.staging import with_dense_id

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents of verdicts (doc_id, kept) that are kept."""
    return docs.join(verdicts.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.with_verdict(docs.select(*COLUMNS)).where("quality.kept").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    score = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).withColumn("score", score(F.col("text"))).where("score < 0.7").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where rows repeat a doc_id, one row of each (doc_id, text) goes on, under a number of its own, so that verdicts
    are for rows."""
    ship(spark)
    docs = docs.select(*COLUMNS).where("doc_id is not null")
    repeated = stage_table(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return _kept(docs, lsh_forest.near_duplicates(docs, size=5, num=80, den=100))
    once = docs.join(repeated.hint("merge"), "doc_id", "left_anti")
    again = docs.join(repeated.hint("merge"), "doc_id", "left_semi")
    again = again.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x")).select("doc_id", "text", "x.*")
    rows = with_dense_id(once.select(*COLUMNS).unionByName(again), ["doc_id", F.xxhash64("text")], "row")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    verdicts = lsh_forest.near_duplicates(numbered, size=5, num=80, den=100).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(verdicts, "row", "left_semi").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that earlier documents cover; what is left of a character that was cut goes, too. A
    document of which nothing is left goes."""
    ship(spark)
    kept = suffix_dedup.suffix_dedup(docs, as_text=True, carried=("lang", "source")).withColumnRenamed("kept", "text")
    return kept.where("text <> '' or n_removed = 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-dedup components, suffix matching and packing have no practical SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
