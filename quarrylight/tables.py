"""Where the tables of a dataset folder are, and how their size turns into partitions."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import threading
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size: file sizes for a scan, without running a job.

    Where it has none (rows made in memory, or by a Python function), the bytes of the text column are summed.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]) // 2


def partitions_for(df: DataFrame, target_mb: float, least: int | None = None) -> int:
    """Partitions of about target_mb of (compressed) input each; grows with the input, never below `least`."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return max(least, math.ceil(plan_bytes(df) / (target_mb * 1e6)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one when running locally."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_remove_local, base)
    return base.rstrip("/")


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


#: Folders for results in between that this process has named and not removed, and those of each thread.
_made: list[str] = []
_mine = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for results in between; gone when the driver ends, or when `remove` is told."""
    if not _made:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in (_made, _of_thread()):
        held.append(path)
    return path


def _of_thread() -> list[str]:
    if not hasattr(_mine, "paths"):
        _mine.paths = []
    return _mine.paths


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read back. Survives lost executors.

    The shuffle files of the write go as soon as it is done: its result is what later steps read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def made() -> list[str]:
    """The folders that this thread has named so far."""
    return list(_of_thread())


def made_since(before: list[str]) -> list[str]:
    """Those it has named since; a step that has written its result passes what that replaces to `remove`."""
    return [f for f in _of_thread() if f not in before]


def remove(paths: list[str]) -> None:
    """Remove folders of `fresh_path`; frames that read them can't be used after."""
    jvm = SparkContext._jvm
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        for held in (_made, _of_thread()):
            if path in held:
                held.remove(path)


def _sweep() -> None:
    with contextlib.suppress(Exception):  # the driver ends; a store that can't be reached any more is no reason to fail
        remove(list(_made))


#: Rows and bytes of a batch that goes to a Python worker, where the session does not say.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches to Python workers small: the defaults (10,000 rows, 64 MB) hold too much off-heap memory for long texts.

    A session that sets either figure itself keeps it.
    """
    defaults = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES)}
    for key, (default, value) in defaults.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))
