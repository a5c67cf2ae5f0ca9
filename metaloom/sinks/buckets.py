"""Snapshots in hash buckets: an upsert rewrites only the buckets that its keys fall into.

A store is a folder:

* ``data/version=v/bucket=b`` holds rows; a version has only the buckets that its batch touched;
* ``pointers/version=v`` says for every bucket which version holds it now. It is written last, so a reader sees a batch
  whole or not at all, and whoever read an older pointer can go on reading its files;
* ``changes/version=v`` has the delta counts of the batch.

A batch that is run again after a failure overwrites its own version, bucket by bucket (dynamic partition overwrite), from the same earlier
pointer. ``compact`` rewrites the buckets that consist of many small files or old versions; ``vacuum`` removes
versions that no kept pointer names. The number of buckets is part of the store and fixed when it is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaloom.sinks.upsert import DELETED, MISSING, delta_counts, one_per_key, upsert
from metaloom.staging import new_stage, stage

BUCKET = "_bucket"


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, list(keys), buckets
        if BUCKET in schema.names:
            raise ValueError(f"a column may not be named {BUCKET}")

    # ------------------------------------------------------------ folders

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, path = self._fs(), self._path("pointers")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(self._path(f"pointers/{n}/_SUCCESS"))]
        return sorted(done)

    def pointer(self, version: int | None = None) -> dict[int, int]:
        """bucket -> version that holds it; buckets without rows are missing. A row per bucket, so its size is fixed."""
        done = self.versions()
        if not done or (version is not None and version not in done):
            return {}
        rows = self.spark.read.schema("bucket int, held long").parquet(f"{self.folder}/pointers/version={done[-1] if version is None else version}").collect()
        return {r["bucket"]: r["held"] for r in rows}

    # --------------------------------------------------------------- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows as of a committed version (the last by default), of some buckets or of all."""
        held = {b: v for b, v in self.pointer(version).items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/version={v}/{BUCKET}={b}" for b, v in sorted(held.items())])

    def _write(self, rows: DataFrame, version: int, touched: Sequence[int], before: dict[int, int]) -> None:
        data = f"{self.folder}/data/version={version}"
        placed = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(data)
        fs = self._fs()
        filled = [b for b in touched if fs.exists(self._path(f"data/version={version}/{BUCKET}={b}"))]
        now = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(filled, version)
        pointer = self.spark.createDataFrame(sorted(now.items()), "bucket int, held long")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointers/version={version}")

    def merge(self, incoming: DataFrame, version: int, drop_missing: bool = False, keep: Sequence[str] = ()) -> DataFrame:
        """Upsert a batch as ``version``; the changed rows with ``_change``, of touched buckets only.

        ``version`` must be newer than the last committed one, or that one again. With ``drop_missing`` the batch is the whole of the
        source: stored rows that it doesn't bring are removed, and every bucket is touched.
        """
        earlier = [v for v in self.versions() if v < version]
        if any(v > version for v in self.versions()):
            raise ValueError(f"version {version} is older than the last one")
        before = self.pointer(earlier[-1]) if earlier else {}
        batch = stage(one_per_key(incoming.select(*self.schema.names), self.keys), new_stage(self.spark, "bucket-batch"))
        met = {r[0] for r in batch.select(self._bucket()).distinct().collect()}  # a number per bucket
        touched = sorted(met | set(before)) if drop_missing else sorted(met)
        stored = self.read(earlier[-1], touched) if earlier else self.spark.createDataFrame([], self.schema)
        changed = stage(upsert(stored, batch, self.keys, keep), new_stage(self.spark, "bucket-changes"))
        rows = changed.where(F.col("_change") != MISSING) if drop_missing else changed
        counted = changed.withColumn("_change", F.when(F.col("_change") == MISSING, DELETED).otherwise(F.col("_change"))) if drop_missing else changed
        delta_counts({"rows": counted}).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/changes/version={version}")
        self._write(rows.drop("_change"), version, touched, before)
        return changed

    def changes(self) -> DataFrame:
        """(version, entity, created, updated, unchanged, deleted) of all batches."""
        return self.spark.read.parquet(f"{self.folder}/changes")

    # --------------------------------------------------------- maintenance

    def compact(self, version: int, most_files: int = 1) -> list[int]:
        """Rewrite the buckets of more than ``most_files`` files, each as one file; which they were."""
        before, fs = self.pointer(), self._fs()
        files = {b: sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(self._path(f"data/version={v}/{BUCKET}={b}"))) for b, v in before.items()}
        many = sorted(b for b, n in files.items() if n > most_files)
        if many:
            self._write(self.read(only=many), version, many, before)
        return many

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove data and pointers that the last ``keep`` versions don't need; the versions whose data is gone altogether."""
        done, fs = self.versions(), self._fs()
        kept = done[-keep:]
        needed = {(b, v) for k in kept for b, v in self.pointer(k).items()}
        gone = []
        for v in [x for x in done if x not in kept]:
            fs.delete(self._path(f"pointers/version={v}"), True)
        if not fs.exists(self._path("data")):
            return gone
        for folder in fs.listStatus(self._path("data")):
            name = folder.getPath().getName()
            v = int(name.split("=")[1])
            left = 0
            for part in fs.listStatus(folder.getPath()):
                bucket = part.getPath().getName()
                if bucket.startswith(f"{BUCKET}="):
                    if (int(bucket.split("=")[1]), v) in needed or v > kept[-1]:
                        left += 1
                    else:
                        fs.delete(part.getPath(), True)
            if not left and v <= kept[-1]:
                fs.delete(folder.getPath(), True)
                gone.append(v)
        return sorted(gone)


def refresh_view(spark: SparkSession, summary: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Bring a materialised summary up to date: (the rows now, the rows that changed with ``_change``).

    The summary is computed once; a bucket whose rows are all as before is not written again.
    """
    store = BucketStore(spark, folder, summary.schema, keys, buckets)
    done = store.versions()
    version = done[-1] + 1 if done else 1
    fresh = stage(summary, new_stage(spark, "summary"))
    changed = upsert(store.read(), one_per_key(fresh, keys), keys)
    changed = stage(changed.where("_change <> 'unchanged'"), new_stage(spark, "summary-changes"))
    touched = [r[0] for r in changed.select(store._bucket()).distinct().collect()]
    rows = fresh.where(store._bucket().isin(touched)) if touched else fresh.limit(0)
    if touched or not done:
        store._write(rows, version, touched, store.pointer())
    return store.read(), changed
