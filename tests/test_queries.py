"""Every query with SQL, on the smallest tables, in both engines; and some plans."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.5f}"
    return "null" if v is None else str(v) if isinstance(v, (str, datetime.date)) else str(int(v))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["q5_3_bm25_scores", "q5_5_dense_topk", "q5_10_search_hybrid"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["q2_08_page_heading", "q2_09_with_heading"])
def test_headings_of_pages_that_share_an_address(spark, tmp_path, name):
    """Three pages of one address: each heading is of its own title and text, one of them has no title."""
    body = "</h1>" + "<p>Some words that make a block of enough characters. " * 3
    pages = [(k, u, f"<title>T{k} of it</title><h1>T{h} of it, at length{body}") for k, u, h in [(0, "a", 0), (2, "a", 1), (4, "a", 4), (1, "b", 1), (6, "c", 8), (8, "c", 6), (9, "d", 9)]]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = __spark_entry__.queries()[name](spark, str(tmp_path)), con.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("docs", [[(None, "a"), ("", "b\n"), ("x/y z", None), ("*", "é가\n\nc"), ("%2F+", ""), ("s", "a"), ("s", "a")], []])
def test_documents_of_any_source_are_read_again(spark, tmp_path, docs):
    spark.createDataFrame(docs, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = __spark_entry__.queries()["q1_1_read_documents"](spark, str(tmp_path)), con.sql(SQL["q1_1_read_documents"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("binaryFile") <= 1  # content stays in one scan
