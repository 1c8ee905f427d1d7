"""Scalar functions against the worked examples of the source behaviour."""

import pytest
from pyspark.sql import functions as F

from penawar.functions import text as tx
from penawar.operators import quote


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [
    ("Rp 1.250.000,50", 1250000.5), ("1.499", 1499.0), ("1,250,000", 1.25), ("Rp5.000 - Rp9.000", 5000.0),
    ("IDR 5000", 0.0), ("", 0.0), (None, 0.0), ("rp 12.000", 12000.0),
])
def test_parse_price(spark, text, expected):
    assert one(spark, tx.parse_price, text) == expected


@pytest.mark.parametrize("text,expected", [("12,5", 12.5), ("1.500.000", 0.0), ("1-2", 0.0), ("", 0.0), (None, 0.0), ("Rp 200", 200.0), ("abc", 0.0)])
def test_edited_number(spark, text, expected):
    assert one(spark, tx.edited_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('text [{"a":1},{"a":2}] text', '[{"a":1},{"a":2}]'),
    ('no json here', 'no json here'),
    ('x {"a": [1]} y', '{"a": [1]}'),
    ('broken {', ''),
])
def test_json_in_text(spark, text, expected):
    assert one(spark, tx.json_in_text, text) == expected


def test_json_parse_failure(spark):
    assert one(spark, lambda c: tx.json_parses(tx.json_in_text(c)), "no json here") is False
    assert one(spark, lambda c: tx.json_parses(tx.json_in_text(c)), '```\n{"id": 1}\n```') is True


@pytest.mark.parametrize("text,expected", [("2,5", 1.0), ("0", 1.0), ("3", 3.0), (None, 1.0), ("abc", 1.0), ("5d", 1.0),
                                           ("12f", 1.0), ("1e2", 100.0), (" 7 ", 7.0), ("0x10", 16.0)])
def test_qty_default(spark, text, expected):
    assert one(spark, tx.qty_default, text) == expected


@pytest.mark.parametrize("text,expected", [("1.7", 1.0), ("-1", 0.0), ("high", 0.0), ("0.85", 0.85)])
def test_clamp_confidence(spark, text, expected):
    assert one(spark, tx.clamp_confidence, text) == expected


def test_js_trim_blank_class(spark):
    s = "﻿ \t  Kertas A4 　\r"
    assert one(spark, tx.js_trim, s) == "Kertas A4"
    assert one(spark, tx.normalise_key, "  Kertas A4 ") == "kertas a4"


def test_embedding_text(spark):
    df = spark.createDataFrame([("A", None, "C"), ("A", "", "C"), ("A", "B", "C")], "n string, b string, c string")
    assert [r[0] for r in df.select(tx.embedding_text("n", "b", "c")).collect()] == ["A | C", "A | C", "A | B | C"]


def test_format_rupiah(spark):
    assert one(spark, tx.format_rupiah, 1234567.4, "double") == "Rp 1.234.567,4"
    assert one(spark, tx.format_rupiah, 1234.56789, "double") == "Rp 1.234,568"
    assert one(spark, tx.format_rupiah, -2500.0, "double") == "Rp -2.500"
    assert one(spark, lambda c: tx.format_rupiah(c, decimals=0), 1234567.4, "double") == "Rp 1.234.567"
    assert one(spark, tx.format_rupiah, None, "double") == "-"


def test_subtotal(spark):
    rows = [(2.0, 100.0, "user_selected_internet", 10.0), (2.0, 100.0, "auto_database", 10.0),
            (2.0, None, "auto_database", 0.0), (None, 100.0, "auto_database", None)]
    df = spark.createDataFrame(rows, "qty double, price double, source string, margin double")
    got = [r[0] for r in df.select(quote.subtotal()).collect()]
    assert got[0] == pytest.approx(220.0) and got[1] == 200.0 and got[2] is None and got[3] == 0.0


def test_status_label(spark):
    df = spark.createDataFrame([("auto_database",), ("mystery",)], "s string")
    label, tone = tx.status_label("s")
    assert [tuple(r) for r in df.select(label, tone).collect()] == [("Cocok otomatis", "ok"), ("mystery", "bad")]


@pytest.mark.parametrize("value,expected", [(10.0, "10"), (25000000.0, "25000000"), (2.5, "2.5"), (12345678.25, "12345678.25"), (-3.0, "-3"), (0.0, "0")])
def test_number_text(spark, value, expected):
    assert one(spark, tx.number_text, value, "double") == expected


def test_vector_literal_round_trip(spark):
    df = spark.createDataFrame([([0.5, -1.25, 3.0],)], "v array<float>")
    r = df.select(tx.vector_literal("v").alias("t"), tx.parse_vector_literal(tx.vector_literal("v")).alias("b"), tx.cosine("v", "v").alias("c")).first()
    assert r.t == "[0.5,-1.25,3.0]" and r.b == [0.5, -1.25, 3.0] and r.c == pytest.approx(1.0)
