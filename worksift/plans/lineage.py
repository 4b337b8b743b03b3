"""Where lineage is cut and where shared files go."""

from __future__ import annotations

import atexit
import shutil
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast side may have, by its counted rows.
BROADCAST_BYTES = 64 << 20


def _base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; else the warehouse, if executors see it: in local mode, or in a store with a scheme.

    A cluster whose warehouse is on a local disk must name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if warehouse.startswith(("/", "file:")) and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
    return warehouse


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see; on the local disk it is removed when the driver's Python ends."""
    path = f"{_base(spark)}/_worksift_{uuid.uuid4().hex}"
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return path


#: Spark's setting that removes an action's shuffle files when it ends, and who holds it in each session: (count, value before).
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HELD: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what is materialised inside go when it is; they stayed until the driver's JVM collected its garbage."""
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _HELD.get(key) or (0, spark.conf.get(CLEANS))
        _HELD[key] = (n + 1, before)
        spark.conf.set(CLEANS, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _HELD[key]
            if n > 1:
                _HELD[key] = (n - 1, before)
            else:
                del _HELD[key]
                spark.conf.set(CLEANS, before)


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """The results of independent steps, run at once: each is many short jobs, that alone leave cores idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def cut(df: DataFrame) -> DataFrame:
    """Materialise rows that an iteration or several branches read, in the session's checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
    with cleaned(spark):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: for rows with texts. A checkpoint's rows aren't compressed.

    A join with it must say if it merges, because the table's size is a compressed one.
    """
    path = shared_folder(df.sparkSession)
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A materialised side of a join, marked for broadcast if its counted rows fit ``BROADCAST_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
