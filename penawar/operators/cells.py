"""Cells of bounded size for joins through an index whose lists may be very long or very hot.

``asked`` and ``listed`` rows meet where they share an index entry (a trigram, a hash code). An entry's list is dealt
into slices of about ``list_rows`` rows and its askers into slices of about ``ask_rows``; each pair of slices is a cell.
Entries that are short on both sides share cells, so many that neither side of one is long. So no task holds more than a cell, whatever an entry's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penawar.session import cut_lineage

BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast when the rows are few, by a count that reads no more than the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def entry_cells(asked: DataFrame, listed: DataFrame, entry: str, list_rows: int, ask_rows: int) -> DataFrame:
    """(entry, n_slices, q_slices, cell) for every entry that both sides have."""
    n = listed.groupBy(entry).agg(F.count(F.lit(1)).alias("n"))
    q = asked.groupBy(entry).agg(F.count(F.lit(1)).alias("q"))
    short = (F.col("n") * 8 <= list_rows) & (F.col("q") * 4 <= ask_rows)
    lists = cut_lineage(n.join(q, entry).withColumn("short", short))
    held, askers = lists.where("short").agg(F.sum("n"), F.sum("q")).first()
    bins = max(1, -(-(held or 0) // list_rows), -(-(askers or 0) // ask_rows))
    cell = F.when(F.col("short"), F.concat(F.lit("bin "), F.pmod(F.xxhash64(entry), F.lit(bins)).cast("string"))) \
        .otherwise(F.concat(F.lit("list "), F.col(entry)))
    return lists.select(entry, F.when(F.col("short"), 1).otherwise(F.ceil(F.col("n") / list_rows)).alias("n_slices"),
                        F.when(F.col("short"), 1).otherwise(F.ceil(F.col("q") / ask_rows)).alias("q_slices"), cell.alias("cell"))


def in_cells(asked: DataFrame, listed: DataFrame, entry: str, ask_id: str, list_id: str, parts: int,
             list_rows: int = 4096, ask_rows: int = 1024):
    """Both sides dealt to their cells and cogrouped; ``applyInPandas`` sees the columns of each side and its cell's keys."""
    cells = small(entry_cells(asked, listed, entry, list_rows, ask_rows))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    q = asked.join(cells, entry).select(*asked.columns, "cell", F.pmod(F.xxhash64(ask_id), F.col("q_slices")).alias("qs"), every("n_slices").alias("ns"))
    n = listed.join(cells, entry).select(*listed.columns, F.col("cell").alias("_cell"), F.pmod(F.xxhash64(list_id), F.col("n_slices")).alias("_ns"),
                                         every("q_slices").alias("_qs"))
    # the explicit partition count keeps AQE from coalescing a small shuffle into a few CPU-heavy tasks
    at, there = ["cell", "qs", "ns"], ["_cell", "_qs", "_ns"]
    return q.repartition(parts, *at).groupBy(*at).cogroup(n.repartition(parts, *there).groupBy(*there))
