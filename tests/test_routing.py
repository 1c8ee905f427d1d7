"""Routing rules, rule reranker, paging and answers on small inline cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from penawar.operators import catalog as cat_ops
from penawar.operators import route as route_ops
from penawar.operators.extract import extract_rules
from penawar.operators.rerank import rule_rerank
from penawar.operators.search import obvious

CAND = "name string, qvec_id long, rank int, id string, name_c string, brand string, category string, score double"


def test_obvious_match_rules(spark):
    rows = [("a", 1, 1, "48", "Mouse Logitech M720", "", "", 1.0), ("a", 1, 2, "49", "Mouse Logitech M330", "", "", 0.5714),
            ("b", 1, 1, "57", "AC Daikin 1 PK", "", "", 1.0), ("b", 1, 2, "58", "AC Daikin 1.5 PK", "", "", 0.8824),
            ("c", 1, 1, "38", "Pulpen Pilot G2 0.5 Biru", "", "", 1.0)]
    ob = {r["name"]: r["obvious"] for r in obvious(spark.createDataFrame(rows, CAND), ["name", "qvec_id"]).collect()}
    assert ob == {"a": True, "b": False, "c": True}


def test_rule_reranker_number_trap(spark):
    rows = [("AC Daikin 1 PK", 1, 1, "57", "AC Daikin 1 PK", "Daikin", "AC", 1.0),
            ("AC Daikin 1 PK", 1, 2, "58", "AC Daikin 1.5 PK", "Daikin", "AC", 0.88),
            ("AC Daikin 1 PK", 1, 3, "59", "AC Daikin 2 PK", "Daikin", "AC", 0.76),
            ("Sepatu Nike Air Force 1 Putih", 1, 1, "1", "Sepatu Nike Air Force 1 Putih 41", "Nike", "Footwear", 0.91),
            ("Sepatu Nike Air Force 1 Putih", 1, 2, "2", "Sepatu Nike Air Force 1 Putih 42", "Nike", "Footwear", 0.91),
            ("Jam Garmin Forerunner 265", 1, 1, "19", "Jam Garmin Forerunner 955", "Garmin", "Watch", 0.39)]
    v = {r["name"]: (r["id"], r["confidence"], r["reason"])
         for r in rule_rerank(spark.createDataFrame(rows, CAND), ["name", "qvec_id"]).collect()}
    assert v["AC Daikin 1 PK"] == ("57", 0.9, "single_match")
    assert v["Sepatu Nike Air Force 1 Putih"] == ("1", 0.5, "ambiguous")
    assert v["Jam Garmin Forerunner 265"] == (None, 0.0, "no_match")


def test_extraction_rules(spark):
    df = spark.createDataFrame([("10 rim Kertas HVS A4 80gr",), ("Mouse Logitech M720 Triathlon Wireless",),
                                ("Kabel NYM 3x2,5 50 meter",), ("2 pasang Sepatu Safety Krisbow 42",),
                                ("32 inch Monitor",), ("3 Meja Kantor",), ("2 x Meja Kantor",), ("2x Meja",), ("2,5 Kabel",), ("3 x rim Kertas",)],
                               "raw_text string")
    got = [(r.name, r.qty, r.unit) for r in extract_rules(df).collect()]
    assert got == [("Kertas HVS A4 80gr", 10.0, "rim"), ("Mouse Logitech M720 Triathlon Wireless", 1.0, "pcs"),
                   ("Kabel NYM 3x2,5", 50.0, "meter"), ("Sepatu Safety Krisbow 42", 2.0, "pasang"),
                   ("32 inch Monitor", 1.0, "pcs"), ("Meja Kantor", 3.0, "pcs"), ("Meja Kantor", 2.0, "pcs"),
                   ("Meja", 2.0, "pcs"), ("Kabel", 2.5, "pcs"), ("Kertas", 3.0, "rim")]


@pytest.mark.parametrize("limit,offset,expected", [("500", "0", (100, 0)), ("0", "0", (25, 0)), (None, "-5", (25, 0)),
                                                   ("abc", "10", (25, 10))])
def test_page_params(limit, offset, expected):
    assert cat_ops.page_params(limit, offset) == expected


def test_page_info(spark):
    df = spark.createDataFrame([(51, 0), (50, 0), (0, 0)], "total long, offset int")
    got = [(r.last_offset, r.from_row, r.to_row) for r in cat_ops.page_info(df, 25).collect()]
    assert got == [(50, 1, 25), (25, 1, 25), (0, 0, 0)]


def test_validation_first_error_wins(spark):
    cols = "change_id long, op string, id long, name string, brand string, category string, unit string, price string, " \
           "has_name boolean, has_brand boolean, has_category boolean, has_unit boolean, has_price boolean"
    rows = [(1, "create", None, " Meja ", None, None, None, "-1", True, False, False, False, True),
            (2, "create", None, None, None, None, None, "5", False, False, False, False, True),
            (3, "update", 1, None, None, None, " ", "", False, False, False, True, True),
            (4, "update", 1, None, None, None, None, None, False, False, False, False, False),
            (5, "update", 1, "  ", None, None, None, None, True, False, False, False, False)]
    v = cat_ops.validate(spark.createDataFrame(rows, cols).withColumn("p", F.col("op") == "update"), partial_col="p")
    got = [(r.change_id, r.error, r.clean_unit, r.clean_price) for r in v.orderBy("change_id").collect()]
    # clean values are computed field by field; the error rejects the whole row
    assert got == [(1, "Harga harus angka >= 0", None, None), (2, "Nama produk wajib diisi", None, Decimal("5.00")),
                   (3, None, None, None), (4, "Tidak ada field yang diubah", None, None),
                   (5, "Nama produk wajib diisi", None, None)]


def test_first_answer_wins_and_timeout(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    q = spark.createDataFrame([("s", 0, t0, "barang"), ("s", 1, t0, "barang 2")],
                              "session_id string, line_index int, asked_at timestamp, name string")
    c = spark.createDataFrame([
        ("s", 0, "product", "7", None, t0 + dt.timedelta(minutes=2), 2),
        ("s", 0, "cancel", None, None, t0 + dt.timedelta(minutes=1), 1),
        ("s", 1, "product", "7", None, t0 + dt.timedelta(minutes=6), 3)],
        "session_id string, line_index int, type string, id string, url string, at timestamp, event_id long")
    cands = spark.createDataFrame([("s", 0, 1, "7", "Meja", 10.0, None, None, None)],
                                  "session_id string, line_index int, rank int, id string, name string, price double, "
                                  "url string, title string, supplier string")
    got = {r.line_index: (r.source, r.reason) for r in route_ops.apply_choices(q, c, cands).collect()}
    assert got == {0: ("cancelled", None), 1: ("skipped", "input_timeout")}


def test_dense_ids_are_consecutive_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = cat_ops.dense_ids(df, "k", 10).select("k", "id").orderBy("k").collect()
    assert [r.id for r in got] == list(range(10, 5010))  # whatever the partitioning


def test_apply_changes_create_update_delete(spark):
    cat = spark.createDataFrame([(1, "Meja", "A", "F", 10.0, "pcs"), (2, "Kursi", "B", "F", 5.0, "pcs")],
                                "id long, name string, brand string, category string, price double, unit string") \
        .withColumn("price", F.col("price").cast("decimal(15,2)"))
    cols = "change_id long, op string, id long, name string, brand string, category string, unit string, price string, " \
           "has_name boolean, has_brand boolean, has_category boolean, has_unit boolean, has_price boolean"
    ch = spark.createDataFrame([
        (1, "update", 1, None, None, None, None, "12", False, False, False, False, True),
        (2, "update", 1, "Meja Besar", None, None, None, None, True, False, False, False, False),
        (3, "delete", 2, None, None, None, None, None, False, False, False, False, False),
        (4, "create", None, "Lemari", None, None, None, None, True, False, False, False, False),
        (5, "update", 99, "X", None, None, None, None, True, False, False, False, False)], cols)
    out = cat_ops.apply_changes(cat, ch)
    snap = {r.id: (r.name, float(r.price) if r.price is not None else None, r.unit, r.reembed)
            for r in out["snapshot"].collect()}
    assert snap == {1: ("Meja Besar", 12.0, "pcs", True), 3: ("Lemari", None, "pcs", True)}
    assert [r.id for r in out["deleted"].collect()] == [2]
    assert [(r.id, r.error) for r in out["missing"].collect()] == [(99, "Produk tidak ditemukan")]


def test_number_within_hot_session_spans_partitions(spark):
    from penawar.operators.quote import number_within

    # one session holds most rows; the global sort spreads it over several partitions
    rows = [("hot", i) for i in range(3000)] + [(f"s{i}", j) for i in range(50) for j in range(3)]
    df = spark.createDataFrame(rows, "session_id string, line_index int").repartition(9)
    got = number_within(df, "session_id", "line_index").collect()
    by = {}
    for r in got:
        by.setdefault(r.session_id, []).append((r.line_index, r.no))
    assert sorted(by["hot"]) == [(i, i + 1) for i in range(3000)]
    assert all(sorted(v) == [(0, 1), (1, 2), (2, 3)] for k, v in by.items() if k != "hot")


def test_running_sum_hot_session_spans_partitions(spark):
    from penawar.operators.sessions import running_sum

    rows = [("hot", i, 1 if i % 3 else -1) for i in range(3000)] + [("s", 0, 1), ("s", 1, -1)]
    df = spark.createDataFrame(rows, "session_id string, t long, delta int").repartition(7)
    got = {(r.session_id, r.t): r.running for r in running_sum(df, "session_id", ["t"], "delta", "running").collect()}
    acc = 0
    for i in range(3000):
        acc += 1 if i % 3 else -1
        assert got[("hot", i)] == acc
    assert got[("s", 0)] == 1 and got[("s", 1)] == 0


def test_routing_looks_for_offers_and_counts_them(spark):
    cands = spark.createDataFrame([("mouse", 1, 1, "48", "mouse", "", "", 1.0), ("mouse", None, 1, "48", "mouse", "", "", 1.0),
                                   ("baut M8", 2, 1, "5", "Baut M9", "", "", 0.5),
                                   ("sepatu", 3, 1, "1", "sepatu 41", "", "", 0.9), ("sepatu", 3, 2, "2", "sepatu 42", "", "", 0.9)], CAND)
    pairs = spark.createDataFrame([("mouse", 1), ("mouse", None), ("baut M8", 2), ("sepatu", 3), ("gergaji", 4), ("paku", 5)], "name string, qvec_id long")
    asked = []

    def find(need):
        asked.extend(r["query"] for r in need.collect())
        return need.where(F.col("query") != "paku").select("query", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos"))

    routes, offers = route_ops.route_pairs(cands, pairs=pairs, find=find)
    got = {(r["name"], r["qvec_id"]): (r["route"], r["n_candidates"], r["n_offers"], r["source"], r["reason"], r["product_id"]) for r in routes.collect()}
    assert sorted(asked) == ["baut M8", "gergaji", "paku"] and offers.count() == 4
    assert got == {("mouse", 1): ("auto_database", 1, 0, "auto_database", None, "48"), ("mouse", None): ("auto_database", 1, 0, "auto_database", None, "48"),
                   ("baut M8", 2): ("offers", 1, 2, None, "internet_fallback", None), ("sepatu", 3): ("ask", 2, 0, None, "ambiguous", None),
                   ("gergaji", 4): ("offers", 0, 2, None, "internet_fallback", None), ("paku", 5): ("offers", 0, 0, "not_found", None, None)}
