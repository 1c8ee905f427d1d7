"""Running sums and numbers within a key that may hold most rows.

Rows are grouped into chunks of a key by a monotone function of the order (line number div 1,000,
or a time bucket). Chunk sums are a small table; their running sum gives every chunk's offset, and a
window runs only inside a chunk. So a huge key is summed by many tasks, without sorting the whole
table and without a checkpoint, and the result doesn't depend on the partitioning. The chunk sums of a
whole table (no key) are summed in chunks themselves, so that the last window holds one row per
``FOLD`` chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penawar.operators.cells import small
from penawar.session import cut_files

FOLD = 8192


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str,
            folds: int | None = None, near: bool = False) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over the rows of the same ``keys`` up to this one in ``order``.

    ``chunk`` must not decrease along ``order``. A null chunk (null order) comes first. ``folds``: how many times the
    chunk sums are summed in chunks before one window takes a key's rest; once for a table without keys by default.
    ``near``: for wide rows that have been shuffled by the keys. They stay where they are, and only the chunks that follow
    another of their key are joined (broadcast if they are few)."""
    folds = folds if folds is not None else 0 if keys else 1
    d = df.withColumn("_chunk", F.coalesce(chunk.cast("long"), F.lit(-(2**62)))).withColumn("_value", value)
    sums = d.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    if folds:
        sums = running(sums.withColumnsRenamed({"_chunk": "_part"}), keys, F.expr(f"_part div {FOLD}"), ["_part"],
                       F.col("_sum"), "_upto", folds - 1)
        part, off = F.col("_part"), F.col("_upto") - F.col("_sum")
    else:
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        part, off = F.col("_chunk"), F.coalesce(F.sum("_sum").over(before), F.lit(0))
    # null-safe keys: rows without a key are a key of their own. A struct is never null and equals another with the same
    # nulls, so the join finds its rows where the window has put them, and they are shuffled once
    sums = sums.select(F.struct(*[F.col(k) for k in keys], part).alias("_k"), off.alias("_off"))
    if near:
        inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_in", F.sum("_value").over(inside)).withColumn("_at", F.struct(*keys, "_chunk"))
        later = small(cut_files(sums.where(F.col("_off") != 0)))
        return (d.join(later, F.col("_at") == F.col("_k"), "left").withColumn(name, F.coalesce("_off", F.lit(0)) + F.col("_in"))
                .drop("_chunk", "_value", "_off", "_in", "_at", "_k"))
    d = d.withColumn("_at", F.struct(*keys, "_chunk"))
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("_value").over(inside))
    return (d.join(sums, F.col("_at") == F.col("_k")).withColumn(name, F.col("_off") + F.col("_in"))
            .drop("_chunk", "_value", "_off", "_in", "_at", "_k"))
