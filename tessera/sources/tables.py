"""Tables between the steps of a query: written once to the shared folder and read as often as needed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named a temporary one serves, but only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: executors have no folder in common")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def file_system(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Let a Python worker get at most so many rows and, where Spark counts them, bytes at once; a batch of whole texts is what its memory depends on most."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def write(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """``df`` as files; the shuffles that it took are deleted when it stands."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of known size: later steps read it instead of computing it again, also after an executor is lost.

    It goes with ``release``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    write(df, path)
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        spark = _written.pop(path, None)
        if spark is not None:
            p, fs = file_system(spark, path)
            fs.delete(p, True)


def _remove_all() -> None:
    """At exit: by the session's file system, or if that has ended, local paths directly; a cluster expires what is left in its checkpoint folder."""
    for path, spark in list(_written.items()):
        try:
            p, fs = file_system(spark, path)
            fs.delete(p, True)
        except Exception:  # the JVM has ended
            local = path.removeprefix("file://")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)
    _written.clear()
