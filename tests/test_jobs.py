"""Table grids, once-only caches, array files, and dense search with bounds."""

import glob
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.html import html_table_shapes, table_grids
from lectern.operators import ask, dense, fusion
from lectern.operators import chunks as ck
from lectern.operators import pages as pg
from lectern.sources import cache, io

# grids


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>a<td colspan=3>b<table><tr><td>i</table><tr><td>c</table>", [(2, 4), (1, 1)]),  # nested
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", [(2, 3)]),
        ("<table><tr><td rowspan='0'>a<tr><td>b<tr><td>c</table>", [(3, 2)]),
        ("<table><thead><tr><td rowspan=9>a</thead><tbody><tr><td>b</table>", [(2, 1)]),  # a group ends spans
        ("<TABLE CLASS=\"x>y\"><TR><TD COLSPAN = '2'>", [(1, 2)]),  # nothing closed
        ("<table><td>a<td>b</table><table></table>", [(1, 2), (0, 0)]),  # a row that is not written
        ("<table><tr><td>a</td></tr><table><tr><td>b<td>c</table>", [(1, 1), (1, 2)]),  # opened outside a cell
        ("<!-- <table> --><script>'<table>'</script><style>a</style><tablet><tr><td>", []),
        ("<table><tr><td colspan=99999>a<td colspan=x rowspan=>b</table>", [(1, 1001)]),
        ("</table><td><tr>", []), ("", []), ("<table", []), ("<!-- open <table><tr><td>", []),
        ("<table><tr><td data-colspan=7>a</table>", [(1, 1)]),
    ],
)
def test_grids(html, want):
    assert table_grids(html) == want


def test_grids_against_marked_squares():
    """Random tables, whose cells are marked square by square on a sheet."""
    rng = random.Random(4)
    for _ in range(300):
        n, taken, width, html = rng.randint(1, 6), set(), 0, "<table>"
        for r in range(n):
            html += "<tr>" + rng.choice(["", "\n", "<!-- <td> -->"])
            x = 0
            for _ in range(rng.randint(1, 4)):
                w, h = rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])
                while (r, x) in taken:
                    x += 1
                taken |= {(r + i, x + j) for i in range(h) for j in range(w)}
                width = max(width, x + w)
                x += w
                html += f"<td colspan={w} rowspan={h}>" + rng.choice(["", "x", "</td>"])
            html += rng.choice(["", "</tr>"])
        assert table_grids(html + rng.choice(["", "</table>"])) == [(n, width)], html


def test_grids_of_rows_and_long_pages(spark):
    pages = [None, "<table><tr><td>" * 2000, "<p>" * 300_000, '<td "' * 50_000, "<table>" + "<tr><td colspan=2>x" * 20_000]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k long, html string")
    got = {r.k: [tuple(x) for x in r.t] for r in df.select("k", html_table_shapes(F.col("html")).alias("t")).collect()}
    assert got == {0: [], 1: [(1, 1)] * 2000, 2: [], 3: [], 4: [(20_000, 2)]}


def test_page_facts_are_those_of_plain_lines(spark):
    rng = random.Random(7)
    texts = ["\n".join("".join(rng.choice("ab \t　\r") for _ in range(rng.choice([0, 5, 11, 12, 21, 30]))) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    texts += ["x" * 1500, "x" * 1501, " " + "x" * 1500 + " ", "\n" * 300 + "y" * 20, "é" * 11 + "\n" + "é" * 11, " " * 100_000, "x y" * 1900]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for r in df.select("k", tx.needs_reread(F.col("t")).alias("poor"), tx.is_degenerate(F.col("t")).alias("bad")).collect():
        body = texts[r.k].strip()
        longest = max((len(x) for x in body.split("\n") if x.strip()), default=0)
        assert r.poor == (len(body) < 200 or longest < 20)
        lines = [x.strip() for x in texts[r.k].split("\n") if len(x.strip()) > 10]
        bad = len(texts[r.k]) > 6000 or bool(lines) and (max(map(len, lines)) > 1500 or len(set(lines)) / len(lines) < 0.5)
        assert r.bad == bad, texts[r.k]


# caches


def test_a_retried_run_adds_its_rows_once(spark, tmp_path):
    path, schema, keys = f"file://{tmp_path}/c", pg.TITLES, pg.PAGE
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert cache.read_cache(spark, path, schema, keys).count() == 0
    assert cache.append_once(rows(), path, "zero", schema, keys).first()[:] == (0, 0)
    first = rows(("a", 1, "t"), ("a", 2, ""), ("a", 2, "again"), ("a", None, "no key"))
    assert cache.append_once(first, path, "one", schema, keys).first()[:] == (2, 2)
    assert cache.append_once(first, path, "one", schema, keys).first()[:] == (2, 2)  # the retry
    assert cache.append_once(rows(("a", 1, "other"), ("b", 1, "x")), path, "two", schema, keys).first()[:] == (1, 1)
    raw = sorted(tuple(r) for r in spark.read.parquet(path).select("doc", "page", "title").collect())
    assert raw == [("a", 1, "t"), ("a", 2, ""), ("b", 1, "x")]
    # two runs at the same time may both have added a page: readers see the first one's
    rows(("a", 1, "late")).withColumn("run", F.lit("three")).write.mode("append").partitionBy("run").parquet(path)
    assert sorted(tuple(r) for r in cache.read_cache(spark, path, schema, keys).collect()) == raw


def test_title_and_reading_jobs_with_a_failing_model(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, "short", None) for p in range(1, 7)], "doc string, page int, raw_text string, tables array<struct<rows:int,cols:int>>").withColumn("number", F.col("page"))
    path = f"file://{tmp_path}/reads"

    def reader(bad):
        def model(rows):
            if int(rows["number"].iloc[0]) in bad:
                raise ValueError("no answer")
            return [f"read {rows['number'].iloc[0]} " + "word " * 9]

        return model

    for run, bad in (("a", {2, 3}), ("a", {2, 3}), ("b", {3}), ("c", set())):
        pg.read_job(pages, pages, path, run, reader(bad), ["number"], batch=1, retries=1)[1].collect()
    assert sorted(r.page for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6]
    titles = f"file://{tmp_path}/titles"
    asked = []
    reads, documents = cache.read_cache(spark, path, pg.READS, pg.PAGE), spark.createDataFrame([("d",)], "doc string")
    titler = lambda bad: lambda rows: reader(bad)(rows) and ["없음" if int(rows["number"].iloc[0]) == 5 else f"# T{rows['number'].iloc[0]}"]
    for run, bad in (("a", {1, 2}), ("b", {2}), ("b", {2}), ("c", set())):
        asked.append(pg.title_job(reads, documents, pages, titles, run, titler(bad), ["number"], batch=1, retries=1).first()[:])
    assert asked == [(6, 4, 2, 0), (2, 1, 1, 0), (2, 1, 1, 0), (1, 1, 0, 0)]  # the empty title of page 5 is not asked for again
    assert sorted((r.page, r.title) for r in spark.read.parquet(titles).collect()) == [(1, "T1"), (2, "T2"), (3, "T3"), (4, "T4"), (5, ""), (6, "T6")]


# files


def test_array_files_are_named_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/scores"
    rows = [(f"A{k:03d}", k % 3, None if k % 2 else 1, "r", k // 40 + 1) for k in range(130)]
    schema = "id string, correctness int, faithfulness int, reason string, batch int"
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert io.write_array_files(spark.createDataFrame([("old", 0, 0, "r", 9)], schema), path, "score") == 1
    assert io.write_array_files(spark.createDataFrame([("kept", 0, 0, "r", 1)], schema), path, "other") == 1
    assert io.write_array_files(df, path, "score") == 4
    names = sorted(p.rsplit("/", 1)[-1] for p in glob.glob(f"{tmp_path}/scores/*"))
    assert names == ["other_01.json", "score_01.json", "score_02.json", "score_03.json", "score_04.json"]
    with open(f"{tmp_path}/scores/score_04.json") as f:
        last = json.load(f)
    assert [r["id"] for r in last] == [f"A{k:03d}" for k in range(120, 130)] and last[1]["faithfulness"] is None and "batch" not in last[0]
    back = {r.id: (r.correctness, r.faithfulness) for r in io.read_scores(spark, f"{path}/score_*.json").collect()}
    assert back == {r[0]: r[1:3] for r in rows}
    assert io.write_array_files(df.withColumn("batch", F.col("batch") * 50), path, "score") == 4  # three digits
    assert sorted(re.findall(r"score_\d+", " ".join(glob.glob(f"{tmp_path}/scores/*")))) == ["score_050", "score_100", "score_150", "score_200"]
    later = spark.createDataFrame([("A000", 2, 2, "second thought", 201)], schema)
    io.write_array_files(later, f"{path}/more", "score")
    assert io.read_scores(spark, f"{path}/more/score_*.json").first().correctness == 2


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    bad = spark.range(10).select(F.col("id").alias("batch"), F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        io.write_array_files(bad, path, "part")
    assert glob.glob(f"{tmp_path}/b/*") == []


# dense search


def plain_topk(q, ids, v, k):
    s = np.round(v @ q, 9)
    return ids[np.lexsort((ids, -s))[:k]].tolist()


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_bounds_leave_out_pairs_exactly(k):
    rng = np.random.default_rng(k)
    v = rng.normal(size=(4000, 32)) * np.linspace(1, 0.02, 32) ** 2  # most of a vector's length is in front
    v[3000] = v[5]
    q, ids = v[:20] + 0.01 * rng.normal(size=(20, 32)), rng.permutation(4000)
    top = dense.TopK(q, k)
    top.show(ids, v)
    assert [row.tolist() for row in top.ids] == [plain_topk(x, ids, v, k) for x in q]
    assert top.shown == 20 * 4000 and (top.multiplied < top.shown / 2 if k < 100 else top.multiplied == top.shown)


def test_dense_search_in_portions_and_by_index(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(30, 8))
    vectors = spark.createDataFrame([(k, x.tolist(), f"i{k % 3}", "d", k) for k, x in enumerate(v)], "chunk_id long, embedding array<double>, index_name string, doc string, page int").repartition(5)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, embedding array<double>")
    ids = np.arange(300)
    for sent in (64 << 20, 2000):
        monkeypatch.setattr(dense, "SENT_BYTES", sent)
        got = {}
        for r in fusion.top_k(dense.dense_topk(asked, vectors, 7), 7).orderBy("rank").collect():
            got.setdefault(r.qid, []).append(r.chunk_id)
        assert got == {k: plain_topk(x, ids, v, 7) for k, x in enumerate(q)}
        found = {}
        for r in ask.search_indexes(asked, vectors, ["i0", "i2"], 4).orderBy("rank").collect():
            found.setdefault((r.index_name, r.qid), []).append((r.rank, r.chunk_id, r.page))
        want = {(f"i{i}", k): plain_topk(x, ids[i::3], v[i::3], 4) for i in (0, 2) for k, x in enumerate(q)}
        assert found == {key: [(n + 1, c, c) for n, c in enumerate(cs)] for key, cs in want.items()}
    assert dense.dense_topk(asked.where("false"), vectors, 3).count() == 0 and dense.dense_topk(asked, vectors.where("false"), 3).count() == 0


def test_a_choice_of_indexes_prunes_partitions(spark, tmp_path):
    place = f"file://{tmp_path}/i"
    rows = spark.createDataFrame([(1, "d", 1, [1.0, 0.0])], "chunk_id long, doc string, page int, embedding array<double>")
    for name in ("a", "b"):
        io.write_index(rows, place, name)
    plan = io.read_index(spark, place).where(F.col("index_name").isin(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*index_name", plan)


def test_documents_are_one_folder_deep_and_many_share_a_task(spark, tmp_path):
    for name in ["top.pdf", "a/x.pdf", "a/y.v2.pdf", "a/z.txt", "a/b/deep.pdf", "k=1/x.pdf", "k=1/_hidden.pdf", *(f"many/{n}.pdf" for n in range(600))]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = io.read_documents(spark, f"file://{tmp_path}/", chars=F.length("content"))
    got = {r["path"].split(f"{tmp_path}/")[1]: (r["doc"], r["bytes"], r["chars"]) for r in found.collect()}
    want = {"a/x.pdf": "x", "a/y.v2.pdf": "y.v2", "k=1/x.pdf": "x"} | {f"many/{n}.pdf": str(n) for n in range(600)}
    assert got == {k: (d, len(k), len(k)) for k, d in want.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file is a partition
    try:
        assert io.read_documents(spark, f"file://{tmp_path}").rdd.getNumPartitions() <= max(603 // io.MERGED, io.MERGED * 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_that_share_a_place_are_not_multiplied_by_pairs(spark):
    """Three pages of one place: a chunk meets each of the place's headings once, as in the SQL of q3_4, and stays single
    where there is none."""
    rows = [("d", p, f"text of page {k} of four, long enough to be a chunk", "cache") for p in (3, 4) for k in range(3)]
    resolved = spark.createDataFrame(rows, "doc string, page int, text string, how string")
    titles = spark.createDataFrame([("d", 3, "Part 3")] * 3, "doc string, page int, title string")
    built = ck.index_of_resolved(resolved, titles).groupBy("page").count().collect()
    assert {r["page"]: r["count"] for r in built} == {3: 9, 4: 3}
