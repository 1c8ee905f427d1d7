"""Split files, page lookup, numbers of a table without a key, published tables."""

import pytest
from pyspark.sql import functions as F

from penawar.operators import catalog as cat_ops
from penawar.operators import chunks, sinks, versions
from penawar.sources import lines as src_lines


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_split_files_have_the_lines_of_whole_files(spark, tmp_path, size):
    texts = {
        "a.txt": "﻿  satu \r\n\r\ndua\r tetap\n  \n" + "".join(f" baris {i} é漢\r\n" * (i % 3) + " \r\n" for i in range(60)) + "akhir",
        "b.txt": "x" * 200 + "\r\n" + "\r\n" * 50 + "y\r\r\n",
        "c.txt": " \r\n\t\n", "d.txt": "", "e.txt": "\n".join(str(i) for i in range(300)) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {(r.path, r.line_index, r.line)
            for r in src_lines.lines_from_text(src_lines.read_text_files(spark, str(tmp_path)), ["path"]).collect()}
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = src_lines.lines_from_files(spark, str(tmp_path))
        rows = got.collect()
        ranges = spark.read.text(str(tmp_path), lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    name = lambda path: path.rsplit("/", 1)[1]
    assert ranges > 5 if size < 1000 else ranges >= 4
    assert len(rows) == len(want)
    assert {(name(r.path), r.line_index, r.line) for r in rows} == {(name(p), i, x) for p, i, x in want}


def test_page_lookup_equals_sorting(spark, tmp_path):
    ids = [i * i for i in range(700)] + [10**12 + i for i in range(300)] + [-5]
    cat = spark.createDataFrame([(i, f"n{i % 7}", "b", "c") for i in ids], "id long, name string, brand string, category string")
    cat.repartitionByRange(10, "id").write.parquet(str(tmp_path / "cat"))
    cat = spark.read.parquet(str(tmp_path / "cat"))
    for q, off in [("", 0), ("", 40), ("", 500), ("", 690), ("", 990), ("", 1001), ("", 5000), ("n3", 100), ("zz", 60)]:
        hits = sorted(i for i in ids if not q or f"n{i % 7}" == q)
        rows = cat_ops.catalog_page(cat, q, 20, off, scan_rows=30).collect()
        assert [r.id for r in rows if r.id is not None] == hits[off:off + 20], (q, off)
        assert {r.total for r in rows} == {len(hits)}


def test_page_lookup_reads_one_range(spark, tmp_path):
    """The page in the middle is cut from a range that reaches the scan as a filter on id."""
    spark.range(20_000).select("id", F.lit("n").alias("name"), F.lit("b").alias("brand"), F.lit("c").alias("category")) \
        .repartitionByRange(8, "id").write.parquet(str(tmp_path / "cat"))
    cat = spark.read.parquet(str(tmp_path / "cat"))
    lo, hi, before = cat_ops._rank_range(cat, 10_000, 50)
    assert before <= 10_000 < before + hi - lo + 1 and hi - lo + 1 <= 50
    page = cat_ops.catalog_page(cat, "", 25, 10_000, scan_rows=50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(id,{lo})" in plan and "LessThanOrEqual(id," in plan
    assert [r.id for r in page.collect()] == list(range(10_000, 10_025))


@pytest.mark.parametrize("folds", [0, 1, 2, None])
def test_numbers_of_a_table_without_a_key(spark, monkeypatch, folds):
    monkeypatch.setattr(chunks, "FOLD", 4)
    ids = [None, -10**6, -7, 0, 3, 4, 5, 999, 1000, 1001, 50_000, 10**9, 10**9 + 1]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "x long")
    got = chunks.running(df, [], F.floor(F.col("x") / 10), ["x"], F.lit(1), "no", folds).collect()
    assert {r.x: r.no for r in got} == {x: n + 1 for n, x in enumerate(ids)}


def test_sums_by_key_in_folds(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FOLD", 3)
    df = spark.createDataFrame([(k, i, i % 5) for k in ("a", None) for i in range(100)], "k string, x long, v long")
    plain = chunks.running(df, ["k"], F.floor(F.col("x") / 2), ["x"], F.col("v"), "s").collect()
    folded = chunks.running(df, ["k"], F.floor(F.col("x") / 2), ["x"], F.col("v"), "s", 2).collect()
    want = {(k, i): sum(j % 5 for j in range(i + 1)) for k in ("a", None) for i in range(100)}
    assert {(r.k, r.x): r.s for r in plain} == {(r.k, r.x): r.s for r in folded} == want


def test_load_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = spark.createDataFrame([(10, "Meja", "F"), (20, "Kertas", "ATK"), (30, "Kursi", "F")], "seed_order long, name string, category string")
    for _ in range(2):  # the second time is a job that is run again
        assert [(r.category, r.first_id, r.n_rows) for r in sinks.write_catalog(rows, path, load_id="a").collect()] == [("F", 1, 2), ("ATK", 2, 1)]
    with pytest.raises(RuntimeError):
        sinks.write_catalog(rows, path, load_id="b")
    old = versions.published(spark, path, "catalog")
    sinks.write_catalog(rows.limit(1), path, reset=True, load_id="b")
    assert [r.id for r in versions.published(spark, path).collect()] == [1]
    assert old.count() == 3  # a reader of the replaced version goes on
    # a change reads the version that it replaces
    now = versions.published(spark, path, "catalog")
    sinks.write_snapshot(now.unionByName(now).withColumn("reembed", F.lit(True)), path, change_id="c")
    assert versions.published(spark, path, "catalog").count() == 2
    assert versions.drop_replaced(spark, path) == 0
    assert versions.drop_replaced(spark, path, older_than_hours=-1) == 3
    assert versions.published(spark, path, "catalog").count() == 2


def test_export_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "sheets")

    def sheet(day, n):
        return spark.range(1, n + 1).select(F.lit("s").alias("session_id"), F.col("id").alias("sheet_row"),
                                            F.lit(day).cast("date").alias("export_date"))

    sinks.write_sheet(sheet("2024-01-02", 5), path, export_id="one")
    sinks.write_sheet(sheet("2024-01-02", 5), path, export_id="one")
    sinks.write_sheet(sheet("2024-01-03", 2), path, export_id="two")
    got = versions.published(spark, path)
    assert sorted(got.columns) == ["export_date", "session_id", "sheet_row"]
    assert sorted((str(r.export_date), r.sheet_row) for r in got.collect()) == [("2024-01-02", i) for i in range(1, 6)] + [("2024-01-03", i) for i in (1, 2)]
    assert versions.published(spark, path, "two").count() == 2
    with pytest.raises(ValueError):
        sinks.write_sheet(sheet("2024-01-03", 2), path, export_id="../x")
    with pytest.raises(ValueError):
        versions.published(spark, path, "three")


def test_failure_before_the_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.publish(spark.range(3), path, "x", "r1")
    broken = spark.range(9).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(broken, path, "x", "r2")
    assert versions.published(spark, path, "x").count() == 3

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_point", fail)
        with pytest.raises(OSError):
            versions.publish(spark.range(9), path, "x", "r2")
    assert versions.published(spark, path, "x").count() == 3
    versions.publish(spark.range(9), path, "x", "r2")
    assert versions.published(spark, path, "x").count() == 9


def test_large_session_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 10)
    sheet = spark.range(1, 201).select(F.lit("s").alias("session_id"), F.col("id").alias("sheet_row"), F.lit("2024-01-02").alias("export_date"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # would merge so small stretches again
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        sinks.write_sheet(sheet, str(tmp_path / "sheet"))
    finally:
        spark.conf.set(merging, before)
    files = list((tmp_path / "sheet" / "export_date=2024-01-02").glob("*.parquet"))
    back = spark.read.parquet(str(tmp_path / "sheet"))
    assert len(files) > 1 and back.count() == 200
