"""The corpus pipeline on a small corpus, against brute force stage by stage."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import components_plain, corpus, ids_of, suffix_plain

import corpus_pipeline
from lectern.llm import quality, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(3, 30)
    n = len(rows)
    rows += [(n + k, (t or "") + " moron scum moron stupid") for k, (_, t) in enumerate(rows[:24])]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], FIELDS)
    docs.withColumn("score", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("moron" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    result = None
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name == "best_fit_packing":
            break
        assert result.columns == corpus_pipeline.COLUMNS
        got = {r["doc_id"]: r["text"] for r in result.collect()}
        if name == "quality_rules":
            ids = sorted(rows)
            measured = dict(zip(ids, quality.measure([rows[i] or "" for i in ids]), strict=True))
            keep = {i for i, (n, _, _, _, rep, longest) in measured.items() if n >= 20 and 100 * rep <= 20 * n and longest <= 100}
            rows = {i: t for i, t in rows.items() if i in keep}
        elif name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert len(bad) >= 15 and all("moron" in rows[i] for i in bad)
            rows = {i: t for i, t in rows.items() if i not in bad}
        elif name == "minhash_near_dedup":
            keep = {i for i, v in components_plain(list(rows.items()), 5, 80, 100).items() if v[2]}
            assert len(keep) < len(rows)
            rows = {i: t for i, t in rows.items() if i in keep}
        else:
            left = {i: n - gone for i, n, gone, _, _ in suffix_plain(list(rows.items()))}
            assert {i: len(t.encode()) for i, t in got.items()} == {i: n for i, n in left.items() if n}
            assert sum(left.values()) < sum(len(t.encode()) for t in rows.values())
            rows = got
        assert got == rows
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in got.items()], FIELDS)
    pieces = collections.defaultdict(list)
    for r in result.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in rows.items():
        ids = np.array([*ids_of(t), 2], "<u4")
        assert sorted(pieces[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in sorted(pieces[i])] and sum(n for _, n, _ in pieces[i]) == len(ids)
    assert set(pieces) == set(rows)


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas())
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_stay_one_row(spark):
    rows = [(i, t) for i, t in corpus(4, 12) if t and len(t) > 60][:12]
    tail = " and then some more words that no other text of this table has in it at all"
    docs = spark.createDataFrame([(i, t, f"l{i}", None, len(t)) for i, t in [*rows, *rows[:3] * 20, (rows[5][0], rows[0][1]), (rows[6][0], tail * 3)]], FIELDS)
    near = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert near.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in near.collect()) == sorted([*((i, t, f"l{i}", None) for i, t in rows), (rows[6][0], tail * 3, f"l{rows[6][0]}", None)])
    got = corpus_pipeline.suffix_dedup_stage(spark, near, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"], r["lang"], r["source"]) for r in got.collect()) == sorted((r["doc_id"], r["lang"], None) for r in near.collect())
