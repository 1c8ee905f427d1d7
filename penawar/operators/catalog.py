"""Catalog maintenance as DataFrame operators.

A catalog change is a row of CHANGES(change_id, op, id, name, brand, category, unit,
price, has_name, has_brand, has_category, has_unit, has_price); ``has_x`` says the
field was sent (an explicit blank is sent, a missing field is not).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penawar.config import DEFAULT, MatchConfig
from penawar.functions.text import js_number, js_trim
from penawar.operators.chunks import running

# Validation messages.
MSG_NAME_REQUIRED = "Nama produk wajib diisi"
MSG_BAD_PRICE = "Harga harus angka >= 0"
MSG_NOTHING = "Tidak ada field yang diubah"
MSG_NOT_FOUND = "Produk tidak ditemukan"

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DecimalType(15, 2)),
    T.StructField("unit", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

FIELDS = ("name", "brand", "category", "unit", "price")


def validate(changes: DataFrame, partial_col: str | None = None, partial: bool = False) -> DataFrame:
    """V1: adds clean_* columns and ``error`` (null when valid). First error wins:
    name, then price, then "nothing sent"."""
    part = F.col(partial_col) if partial_col else F.lit(partial)
    name_sent = F.col("has_name") & F.col("name").isNotNull()
    name = js_trim("name")
    name_err = F.when(name_sent & (name == ""), MSG_NAME_REQUIRED).when(~name_sent & ~part, MSG_NAME_REQUIRED)
    cleaned = {"name": F.when(name_sent, name)}
    for f in ("brand", "category", "unit"):
        t = js_trim(f)
        cleaned[f] = F.when(F.col(f"has_{f}") & (t != ""), t)
    ptxt = F.col("price").cast("string")
    pnum = js_number(ptxt)  # blanks are 0, only an empty text or null clears the price
    price_null = ptxt.isNull() | (ptxt == "")
    bad_price = F.col("has_price") & ~price_null & (pnum.isNull() | (F.abs(pnum) == float("inf")) | (pnum < 0))
    cleaned["price"] = F.when(F.col("has_price") & ~price_null & ~bad_price, pnum.cast("decimal(15,2)"))
    any_sent = name_sent | F.col("has_brand") | F.col("has_category") | F.col("has_unit") | F.col("has_price")
    error = F.coalesce(name_err, F.when(bad_price, MSG_BAD_PRICE), F.when(~any_sent, MSG_NOTHING))
    out = changes
    for f, c in cleaned.items():
        out = out.withColumn(f"clean_{f}", c)
    return out.withColumn("name_sent", name_sent).withColumn("error", error)


def search_filter(catalog: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive substring over name OR brand OR category; blank q = all.
    ``%``, ``_`` and ``\\`` in q keep their LIKE meaning, as in the source system."""
    q = (q or "").strip()
    if not q:
        return catalog
    # a backslash before any other character stands for that character
    pat = "%" + re.sub(r"\\([^%_\\])", r"\1", q) + "%"
    return catalog.where(F.col("name").ilike(pat) | F.col("brand").ilike(pat) | F.col("category").ilike(pat))


def page_params(limit, offset, cfg: MatchConfig = DEFAULT) -> tuple[int, int]:
    """K3: limit falsy / not a number -> 25, capped at 100; offset floor 0.
    A negative limit is rejected."""
    try:
        lim = float(limit)
    except (TypeError, ValueError):
        lim = float("nan")
    lim = int(lim) if lim == lim and lim else cfg.page_default
    if lim < 0:
        raise ValueError("limit must not be negative")
    lim = min(lim, cfg.page_max)
    try:
        off = float(offset)
    except (TypeError, ValueError):
        off = 0.0
    off = int(off) if off == off else 0
    return lim, max(off, 0)


RANGES = 1000  # id ranges counted at a time
SCAN_ROWS = 10_000  # a page that ends within so many rows is cut from the smallest ids


def _rank_range(hits: DataFrame, rank: int, most: int) -> tuple[int, int, int] | None:
    """(lo, hi, before): an id range that holds the row of that rank (from 0) by id, and the rows below ``lo``.

    Rows are counted in ``RANGES`` equal id ranges, then within the one that holds the rank, until it has at most
    ``most`` rows or a single id: a few aggregations, each reading the chosen range only."""
    whole = hits.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).first()
    if rank >= whole["n"]:
        return None
    lo, hi, before, n = whole["lo"], whole["hi"], 0, whole["n"]
    while n > most and lo < hi:
        width = -(-(hi - lo + 1) // RANGES)
        inside = hits.where(F.col("id").between(lo, hi)).groupBy(F.expr(f"(id - {lo}) div {width}").alias("part")).count()
        for part, n in sorted(inside.collect()):  # RANGES rows at most
            if before + n > rank:
                break
            before += n
        lo, hi = lo + part * width, min(lo + (part + 1) * width - 1, hi)
    return lo, hi, before


def catalog_page(catalog: DataFrame, q: str | None, limit=None, offset=None, cfg: MatchConfig = DEFAULT,
                 scan_rows: int = SCAN_ROWS) -> DataFrame:
    """K3 + A3: one page ordered by id (not null), with the total of matching rows beside it.

    A page beyond the first ``scan_rows`` rows is looked up by counts per id range: only the ranges that hold its first
    and last row and what lies between them are read and sorted, at most ``2 * scan_rows`` rows and the page."""
    lim, off = page_params(limit, offset, cfg)
    hits = search_filter(catalog, q)
    near, skip = hits, off
    if off + lim > scan_rows:
        first, last = _rank_range(hits, off, scan_rows), _rank_range(hits, off + max(lim, 1) - 1, scan_rows)
        if first is None:
            near, skip = hits.where(F.lit(False)), 0
        else:
            near = hits.where(F.col("id") >= first[0])
            near, skip = near if last is None else near.where(F.col("id") <= last[1]), off - first[2]
    page = near.orderBy("id").offset(skip).limit(lim).withColumn("_k", F.lit(1))
    total = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    # a page past the end is one row with the total alone; the broadcast page has at most page_max rows
    return (total.join(F.broadcast(page), "_k", "left").select(*catalog.columns, "total")
            .withColumn("limit", F.lit(lim)).withColumn("offset", F.lit(off)))


def page_info(counts: DataFrame, page_size: int, offset_col: str = "offset") -> DataFrame:
    """K4: last page offset and the "from-to of total" numbers of a count row."""
    total = F.col("total")
    last = F.when(total <= 0, 0).otherwise(F.floor((total - 1) / page_size) * page_size).cast("long")
    frm = F.when(total == 0, 0).otherwise(F.col(offset_col) + 1)
    to = F.least(F.col(offset_col) + page_size, total)
    return counts.select("*", last.alias("last_offset"), frm.alias("from_row"), to.alias("to_row"))


def align_schema(df: DataFrame, schema: T.StructType = CATALOG_SCHEMA) -> DataFrame:
    """Cast known columns, add missing ones as typed nulls; unit defaults to pcs."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name == "unit" and f.name not in df.columns:
            c = F.lit(DEFAULT.default_unit)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def dense_ids(df: DataFrame, order_col: str, start: int | F.Column = 1, name: str = "id", chunk: int = 1000) -> DataFrame:
    """Consecutive ids from ``start`` on in the order of an integer column (see ``operators.chunks``): lazy, without a
    global sort, a checkpoint or a driver read."""
    base = start if isinstance(start, F.Column) else F.lit(start)
    out = running(df, [], F.floor(F.col(order_col) / chunk), [order_col], F.lit(1), name)
    return out.withColumn(name, (F.col(name) - 1 + base).cast("long"))


def load_catalog(rows: DataFrame, existing: DataFrame | int, reset: bool) -> DataFrame:
    """A bulk load is refused when the target has rows, unless reset;
    ids restart from 1 in the load order. ``existing``: the target table (it is counted), or its count."""
    n = existing if isinstance(existing, int) else existing.count()
    if n > 0 and not reset:
        raise RuntimeError(f"target already holds {n} rows; load with reset")
    return dense_ids(rows, "seed_order", 1)


def load_summary(loaded: DataFrame) -> DataFrame:
    """A5: categories in first-seen order with their row counts."""
    return loaded.groupBy("category").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).orderBy("first_id")


def to_json_rows(catalog: DataFrame) -> DataFrame:
    """Id as text, price as a number (null stays null)."""
    return catalog.select(F.col("id").cast("string").alias("id"), "name", "brand", "category",
                          F.col("price").cast("double").alias("price"), "unit", "created_at")


def _last_sent(field: str) -> F.Column:
    """Per field, the value of the latest change that sent it."""
    return F.max_by(F.col(f"clean_{field}"), F.when(F.col(f"has_{field}") if field != "name" else F.col("name_sent"),
                                                  F.col("change_id")))


def apply_changes(catalog: DataFrame, changes: DataFrame, as_of: str = "2024-06-01 00:00:00") -> dict[str, DataFrame]:
    """C1-C3 + J9 in change order, per id: a change finds its row if the row was there or created earlier and no
    earlier change deleted it; otherwise it is missing. Nothing runs until an output is used.

    Returns snapshot, created (as created), updated (rows with the updates that found them, also if deleted later),
    deleted (rows as they were when deleted), rejected (validation errors) and missing."""
    v = validate(changes.withColumn("_partial", F.col("op") == "update"), partial_col="_partial")
    v = v.withColumn("error", F.when(F.col("op") == "delete", None).otherwise(F.col("error")))
    creates = v.where((F.col("op") == "create") & F.col("error").isNull())
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    numbered = dense_ids(creates, "change_id", 1, "_no").withColumn("_k", F.lit(1))
    new_rows = numbered.join(F.broadcast(top.withColumn("_k", F.lit(1))), "_k").select(
        (F.col("_no") + F.col("_top")).cast("long").alias("id"),
        F.col("clean_name").alias("name"), F.col("clean_brand").alias("brand"),
        F.col("clean_category").alias("category"), F.col("clean_price").alias("price"),
        F.when(F.col("has_unit"), F.col("clean_unit")).otherwise(F.lit(DEFAULT.default_unit)).alias("unit"),
        F.lit(as_of).cast("timestamp").alias("created_at"), F.col("change_id").alias("_born"))
    base = catalog.withColumn("_born", F.lit(None).cast("long"))
    # created rows carry exactly the catalog's own columns (typed nulls for the rest)
    new_rows = new_rows.select([F.col(c).cast(base.schema[c].dataType).alias(c) if c in new_rows.columns
                                else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    rows = base.unionByName(new_rows)

    keyed = v.where(F.col("op").isin("update", "delete"))
    born = rows.select("id", F.col("_born"), F.lit(True).alias("_there"))
    seen = keyed.join(born, "id", "left").withColumn(
        "_there", F.coalesce(F.col("_there") & (F.col("_born").isNull() | (F.col("change_id") > F.col("_born"))), F.lit(False)))
    gone = seen.where(F.col("_there") & (F.col("op") == "delete")).groupBy("id").agg(F.min("change_id").alias("_gone"))
    seen = seen.join(gone, "id", "left")
    found = F.col("_there") & (F.col("_gone").isNull() | (F.col("change_id") <= F.col("_gone")))
    # a change without an id matches nothing
    missing = seen.where(~found).select(*v.columns).withColumn("error", F.lit(MSG_NOT_FOUND))
    found_rows = seen.where(found)
    rejected = found_rows.where(F.col("error").isNotNull()).select(*v.columns).unionByName(
        v.where((F.col("op") == "create") & F.col("error").isNotNull()))
    updates = found_rows.where((F.col("op") == "update") & F.col("error").isNull())
    agg = updates.groupBy("id").agg(*[_last_sent(f).alias(f"new_{f}") for f in FIELDS],
                                    *[F.max(F.col("name_sent") if f == "name" else F.col(f"has_{f}")).alias(f"sent_{f}")
                                      for f in FIELDS], F.lit(True).alias("_updated"))
    upd = rows.join(agg, "id", "left").join(gone, "id", "left")
    cols = [F.when(F.col(f"sent_{f}"), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) if f != "price" else
            F.when(F.col("sent_price"), F.col("new_price")).otherwise(F.col("price")).cast("decimal(15,2)").alias("price")
            for f in FIELDS]
    extra = [c for c in catalog.columns if c not in FIELDS and c != "id"]
    reembed = F.col("_born").isNotNull() | F.coalesce(F.col("sent_name") | F.col("sent_brand") | F.col("sent_category"), F.lit(False))
    state = upd.select("id", *cols, *extra, reembed.alias("reembed"), "_updated", "_gone")
    return {
        "snapshot": state.where(F.col("_gone").isNull()).drop("_updated", "_gone"),
        "created": new_rows.drop("_born").withColumn("reembed", F.lit(True)),
        "updated": state.where(F.col("_updated")).drop("_updated", "_gone"),
        "deleted": state.where(F.col("_gone").isNotNull()).drop("_updated", "_gone", "reembed"),
        "rejected": rejected,
        "missing": missing,
    }
