"""Driver contract: entry runs; every oracle key is a query; queries read the given tables."""

import __spark_entry__ as entry
from penawar.plans.registry import QUERIES


def test_contract_shapes():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 60
    assert set(sql) <= set(qs)


def test_entry_runs(spark):
    df = entry.entry(spark)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert df.count() == lines  # none of the order lines is blank
    assert "source" in df.columns


def test_cheap_queries_run_at_small_scale(spark):
    for name in ("catalog_scan", "quotation_total", "offers_structured", "apply_choices", "session_members"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
