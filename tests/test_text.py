"""Literal edge rows of the column expressions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.html import html_table_shapes


def one(spark, expr, *values):
    return spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).select(expr(*(F.col(f"c{k}") for k in range(len(values))))).first()[0]


@pytest.mark.parametrize("raw", ["  a \t b\n\n c  ", "　x y\xa0", "", "\x1c\x85", "one"])
def test_white_space_is_pythons(spark, raw):
    assert one(spark, tx.normalize_ws, raw) == " ".join(raw.split())
    assert one(spark, tx.squash, raw) == "".join(raw.split())
    assert one(spark, tx.strip, raw) == raw.strip()


def test_tokenize(spark):
    assert one(spark, tx.tokenize, "LectureDeck E7 안전교육 가 été") == ["lecturedeck", "e7", "안전", "전교", "교육", "가", "t"]
    assert one(spark, tx.tokenize, "") == []


@pytest.mark.parametrize(("text", "poor"), [("x" * 199, True), ("x" * 200, False), ("\n".join(["y" * 19] * 16), True), ("\n".join(["y" * 19] * 15 + ["y" * 20]), False), (None, True), ("", True)])
def test_needs_reread(spark, text, poor):
    assert one(spark, lambda c: tx.needs_reread(c), text) is poor


def test_needs_reread_for_tables(spark):
    table = "\n".join(["a | b | c " + "z" * 60] * 4)
    assert one(spark, lambda c: tx.needs_reread(c, tx.table_shapes(c)), table) is True
    assert one(spark, lambda c: tx.needs_reread(c, tx.table_shapes(c)), table.rsplit("\n", 1)[0] + "\n" + "w" * 90) is False


def test_table_shapes(spark):
    text = "head\n| a | b |\n| c | d | e |\nplain\nx | y\n"
    assert [tuple(x) for x in one(spark, tx.table_shapes, text)] == [(2, 3), (1, 2)]
    assert one(spark, tx.table_shapes, None) == []
    html = "<p>x</p><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table>"
    assert [tuple(x) for x in one(spark, html_table_shapes, html)] == [(2, 2)]


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("\n".join(f"line {k:04} " + "z" * 50 for k in range(98))[:6000], False), ("\n".join(f"line {k:04} " + "z" * 50 for k in range(120))[:6001], True),
        ("\n".join(["a" * 20, "b" * 20, "a" * 20, "b" * 20]), False), ("\n".join(["a" * 20] * 4), True), ("short\nlines\n" * 9, False), ("q" * 1501, True),
    ],
)
def test_is_degenerate(spark, text, bad):
    assert one(spark, tx.is_degenerate, text) is bad


@pytest.mark.parametrize(("raw", "title"), [('## "제목"', "제목"), ("없음", ""), ("x" * 81, ""), ("x" * 80, "x" * 80), (" \n y", "")])
def test_clean_title(spark, raw, title):
    assert one(spark, tx.clean_title, raw) == title


@pytest.mark.parametrize(
    ("name", "date"),
    [("20251017_x", "2025-10-17"), ("250702_x", "2025-07-02"), ("x 17.07.05", "2017-07-05"), ("2022년도", "2022"), ("UDD02010", None), ("991399_x 2022년", "2022"), ("x(99.01.16)", "2099-01-16"), ("990116_x", "1999-01-16")],
)
def test_date_from_name(spark, name, date):
    assert one(spark, tx.date_from_name, name) == date


@pytest.mark.parametrize(("text", "date"), [("2025. 7. 2.", "2025-07-02"), ("2025년 7월", "2025-07"), (" " * 1200 + "2025. 7. 2.", None), ("none", None)])
def test_date_from_text(spark, text, date):
    assert one(spark, tx.date_from_text, text) == date


def test_language(spark):
    rows = spark.createDataFrame([(25, 24), (50, 50), (12, 88), (51, 49), (11, 89)], "ko int, en int")
    assert [r[0] for r in rows.select(tx.language(F.col("ko"), F.col("en"))).collect()] == ["mixed", "mixed", "mixed", "ko", "en"]


def test_l2_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(tx.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None, None]
