"""Staged tables: lineage cut points that survive the loss of an executor.

Iterative operators (graph traversal) write each step as a parquet table in
the shared folder named by ``spark.checkpoint.dir`` and read it back.  A
written table, unlike a local checkpoint, is still there when an executor is
lost, and its file sizes let Catalyst choose broadcast or shuffle for the next
step from real numbers.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
#: a step that took so many seconds may have left large shuffle files
LONG_STEP = 3


def staging_root(spark: SparkSession) -> str:
    """Shared folder of this application's staged tables.

    Reads ``spark.checkpoint.dir`` (or the directory set on the context).  Only
    a ``local`` master may fall back to a temporary folder, because there every
    task runs on this machine.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/metaloom-{context.applicationId}"
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="metaloom-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def new_stage(spark: SparkSession, label: str) -> str:
    """A fresh folder path for one run of an iterative operator."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` at ``path`` and return a DataFrame that reads it back.

    Spark deletes the shuffle files of a finished step only when the driver collects its garbage, which a small
    heap may not do for hours: after a long step it is asked to.
    """
    began = time.monotonic()
    df.write.mode("errorifexists").parquet(path)
    if time.monotonic() - began > LONG_STEP:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, path: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``stage``, and a count (of all rows by default) taken while writing."""
    seen = Observation()
    observed = df.observe(seen, (F.count(F.lit(1)) if counted is None else counted).alias("n"))
    return stage(observed, path), seen.get["n"]


_dropped = 0


def generation() -> int:
    """How often staged tables were dropped: who keeps one for later asks whether it is still of this generation."""
    return _dropped


def drop(spark: SparkSession, path: str) -> None:
    """Delete one staged table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application staged; call once results are written."""
    global _dropped
    _dropped += 1
    drop(spark, staging_root(spark))
