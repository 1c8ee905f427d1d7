"""Session helpers: build a local session for tests and benches, and find the
shared checkpoint folder of a cluster session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


# One BLAS thread per Python worker: Spark already runs one task per core.
_WORKER_ENV = {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "MKL_NUM_THREADS": "1"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "penawar") -> SparkSession:
    for k, v in _WORKER_ENV.items():
        os.environ.setdefault(k, v)
    builder = SparkSession.builder
    for k, v in _WORKER_ENV.items():
        builder = builder.config(f"spark.executorEnv.{k}", v)
    spark = (
        builder
        .master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset in a local session (tests) a scratch folder is made;
    a cluster session without it is refused, as executors don't share the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="penawar-ckpt-", dir=os.environ.get("PENAWAR_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, removed when the session ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/penawar-{uuid.uuid4().hex}-{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local).

    The input is cached for the duration of the checkpoint: a reliable checkpoint
    writes in a second job, which would otherwise compute the whole input again.
    The cache is dropped once the rows are written, so nothing accumulates in the
    session's cache manager."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def cut_files(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for rows that grow with the lines: written once as Parquet below the checkpoint folder (compressed,
    read by column, nothing cached), deleted when the session ends."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``penawar`` importable in Python workers (zip shipped with addPyFile).

    Needed by the Arrow tasks (mapInPandas / applyInPandas / pandas_udf); the
    executors of a cluster do not share the driver's source folder.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="penawar-pkg-"), "penawar.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED[key] = out
