"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penawar.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed by the result contracts
# every ASCII character that is no letter or digit separates alphanumeric words
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SPACED_WORD = r"[^\x20\x09-\x0D]+"

# a broadcast side may hold this many rows at most; beyond it the join shuffles
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``, removed when the session ends."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/penawar-{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    ``batch_rows``: rows in an Arrow batch to Python during the write, for rows that hold whole texts (a batch is held
    several times over, in the JVM and in the worker); the session's own setting comes back afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``rows`` rows; else leave the join to shuffle.

    The check reads no more than rows + 1 rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def whole(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def alnum_words(col: str = "text") -> Column:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z: one translation, one split at spaces
    (a regular expression that collects all matches copies the whole text for each)."""
    spaced = F.btrim(F.translate(whole(col), UPPER + BREAKS, LOWER + " " * len(BREAKS)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def word_hash(words: Column, at: Column, n: int = 1) -> Column:
    """Hash of the n words from ``at`` on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def row_key() -> Column:
    """Rows of one doc_id with equal texts get equal results, so (doc_id, hash of text) keys a row."""
    return F.xxhash64(whole())


def same_key(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, _h); a null doc_id meets a null doc_id."""
    b = b.withColumnsRenamed({"doc_id": "_doc_id2", "_h": "_h2"})
    return a.join(b, a["doc_id"].eqNullSafe(b["_doc_id2"]) & (a["_h"] == b["_h2"]), how).drop("_doc_id2", "_h2")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def packed(df: DataFrame) -> DataFrame:
    """(doc_id, text, _h, _row): the whole row in a struct, so that no column of the input can clash."""
    return df.select("doc_id", "text", row_key().alias("_h"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def maybe_in(keys: DataFrame, bits: int = 22) -> Column:
    """A condition on _h that holds for every _h of ``keys`` and for few others while the keys are few.

    The hashes are marked in 2^bits bits, an array of fixed size that a scalar subquery hands to
    the tasks: rows that can't be in ``keys`` need no shuffle. Any number of keys gives right results."""
    slot = f"pmod(_h, {1 << bits}L)"
    marks = (keys.select(F.expr(f"shiftright({slot}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    words = keys.sparkSession.range(1 << (bits - 6)).join(marks, F.col("id") == F.col("w"), "left")
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))),
                                  lambda x: x["b"]).alias("t"))
    return F.bit_get(F.get(table.scalar(), F.expr(f"cast(shiftright({slot}, 6) as int)")), F.expr(f"cast({slot} % 64 as int)")) == 1


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
