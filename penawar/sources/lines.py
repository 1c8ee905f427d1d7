"""Order lines from text files, tables and pasted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penawar.functions.text import js_trim, number_text


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, content), for files of 2 GB at most; ``lines_from_files`` reads larger ones."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def lines_from_text(files: DataFrame, key_cols: list[str], text_col: str = "content") -> DataFrame:
    """Split on ``\\r?\\n``, trim (JavaScript blank class), drop blank
    lines, then number the rest from 0 within each file.

    Trimming and dropping happen in the split array, so the position that
    ``posexplode`` gives is the line number: one narrow stage, no shuffle."""
    pieces = F.transform(F.split(F.col(text_col), "\r?\n"), lambda x: js_trim(x))
    return files.select(*key_cols, F.posexplode(F.filter(pieces, lambda x: x != "")).alias("line_index", "line"))


def lines_from_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 for files of any size: (path, line_index, line) as ``read_text_files`` and ``lines_from_text`` give them.

    Spark cuts the files into byte ranges. A range's kept lines get consecutive ids in the task that reads them, so a
    line's number is its distance from the range's first id plus the kept lines of the file's earlier ranges: a running
    sum over one row per range. The lines themselves are not sorted, and no row holds a file. The ranges are counted in
    a scan of their own, which cuts the same files alike. Lines end at ``\\n``; a ``\\r`` before it is trimmed with
    the blanks, also where a range ends between the two. Files without a kept line give no row."""
    ranged = (spark.read.text(path, lineSep="\n")
              .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                      js_trim("value").alias("line"))
              .where(F.col("line") != "").withColumn("id", F.monotonically_increasing_id()))
    counts = ranged.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ranged.join(offsets, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line_index"), "line")


def lines_keep_gaps(files: DataFrame, key_cols: list[str], text_col: str, sep: str) -> DataFrame:
    """P5: blank pieces are skipped, but the others keep their original index."""
    parts = files.select(*key_cols, F.posexplode(F.split(F.col(text_col), sep)).alias("line_index", "raw_text"))
    return parts.where(js_trim("raw_text") != "")


def lines_from_table(df: DataFrame, key_cols: list[str], cell_cols: list[str]) -> DataFrame:
    """One line per row — the non-blank cells, as text, joined by a space;
    rows with nothing left are dropped. Spreadsheet numbers are doubles: 10.0 is written 10."""
    kinds = dict(df.dtypes)
    cells = F.array(*[number_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in cell_cols])
    kept = F.filter(cells, lambda x: x.isNotNull() & (js_trim(x) != ""))
    line = js_trim(F.array_join(kept, " "))
    return df.select(*key_cols, line.alias("line")).where(F.col("line") != "")
