"""Incremental sync of catalog exports as a stream of files.

The exports have no stream of their own; what the sync keeps is a high-water
mark and an upsert.  A file stream keeps the mark in its checkpoint, and each
micro-batch is one upsert into a new snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaloom.sinks.buckets import BucketStore
from metaloom.sinks.upsert import delta_counts, one_per_key, snapshot, upsert


def watermark(state: DataFrame, source: str) -> DataFrame:
    """(since): start time of the last finished sync of a source."""
    return state.filter((F.col("source") == source) & (F.col("status") == "completed")).agg(F.max("started_at").alias("since"))


def merge_batch(batch: DataFrame, batch_id: int, folder: str, keys: Sequence[str]) -> None:
    """Merge one micro-batch into ``folder``: snapshot ``version=<batch_id + 1>`` and its delta counts.

    Versions are named by batch, so a batch run again after a failure reads the
    same stored version and replaces its own output.
    """
    spark = batch.sparkSession
    incoming = one_per_key(batch, keys)
    stored = spark.read.schema(batch.schema).parquet(f"{folder}/version={batch_id}") if batch_id > 0 else spark.createDataFrame([], batch.schema)
    changed = upsert(stored, incoming, keys)
    snapshot(changed).write.mode("overwrite").parquet(f"{folder}/version={batch_id + 1}")
    delta_counts({"rows": changed}).write.mode("overwrite").parquet(f"{folder}/_delta/version={batch_id + 1}")


def sync_files(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], folder: str, checkpoint: str):
    """Merge every new parquet export under ``path``; returns the started query (available-now)."""
    stream = spark.readStream.schema(schema).parquet(path)
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, folder, keys))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def merge_buckets(batch: DataFrame, batch_id: int, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Merge one micro-batch into a bucket store, as version ``batch_id + 1``; a batch run again replaces its own version."""
    BucketStore(batch.sparkSession, folder, batch.schema, keys, buckets).merge(batch, batch_id + 1)


def sync_buckets(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], folder: str, checkpoint: str, buckets: int = 64):
    """``sync_files`` into a bucket store: a micro-batch rewrites only the buckets of its keys."""
    stream = spark.readStream.schema(schema).parquet(path)
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: merge_buckets(batch, batch_id, folder, keys, buckets))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
