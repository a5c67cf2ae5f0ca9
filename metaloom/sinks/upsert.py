"""Set-based upserts, orphan removal and delta counts over table snapshots.

An upsert is one full outer join of the stored snapshot with the incoming
rows; the result carries ``_change`` and is written as a new snapshot folder
(never over a path being read).  Keys that may be null compare null-safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

CREATED, UPDATED, UNCHANGED, MISSING, DELETED = "created", "updated", "unchanged", "missing", "deleted"


def comparable(df: DataFrame, name: str) -> Column:
    """Column ``name`` in a form that can be compared and ordered: maps become sorted lists of their entries."""
    kind = df.schema[name].dataType
    if isinstance(kind, MapType) and "map<" not in kind.valueType.simpleString():
        return F.array_sort(F.map_entries(name))
    return F.to_json(F.struct(F.col(name).alias("v"))) if "map<" in kind.simpleString() else F.col(name)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One incoming row per key: the last by ``order``, else the greatest row; combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    chosen = F.max_by(row, F.struct(*(comparable(df, c).alias(c) for c in rest)) if order is None else order)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Stored rows merged with incoming ones, plus ``_change``.

    Incoming values win, except columns in ``keep`` (such as first_seen), which
    keep the stored value.  Rows only stored stay as ``missing``; a later
    orphan step decides about them.  Both sides hold a key at most once.
    """
    values = [c for c in stored.columns if c not in keys]
    a = stored.select(*[F.col(c).alias(f"_o_{c}") for c in stored.columns], F.lit(True).alias("_old"))
    b = incoming.select(*[F.col(c).alias(f"_n_{c}") for c in stored.columns], F.lit(True).alias("_new"))
    condition = reduce(lambda x, y: x & y, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    both = a.join(b, condition, "full_outer")
    compared = [v for v in values if v not in keep]
    same = reduce(lambda x, y: x & y, [comparable(both, f"_o_{v}").eqNullSafe(comparable(both, f"_n_{v}")) for v in compared], F.lit(True))
    change = F.when(F.col("_old").isNull(), CREATED).when(F.col("_new").isNull(), MISSING).when(same, UNCHANGED).otherwise(UPDATED)
    key_columns = [F.when(F.col("_new"), F.col(f"_n_{k}")).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys]
    merged = [
        (F.when(F.col("_old"), F.col(f"_o_{v}")).otherwise(F.col(f"_n_{v}")) if v in keep else F.when(F.col("_new"), F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}"))).alias(v)
        for v in values
    ]
    return both.select(*key_columns, *merged, change.alias("_change")).select(*stored.columns, "_change")


def snapshot(changed: DataFrame, drop_missing: bool = False) -> DataFrame:
    """The next snapshot: the rows of an upsert without its marks."""
    rows = changed.filter(F.col("_change") != MISSING) if drop_missing else changed
    return rows.drop("_change")


def delta_counts(changes: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, created, updated, unchanged, deleted) with a row of totals."""
    parts = [df.groupBy("_change").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "_change", "n") for name, df in changes.items()]
    kinds = [CREATED, UPDATED, UNCHANGED, DELETED]
    rows = reduce(DataFrame.unionByName, parts)
    sums = [F.coalesce(F.sum(F.when(F.col("_change") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds]
    return rows.groupBy("entity").agg(*sums).unionByName(rows.groupBy(F.lit("total").alias("entity")).agg(*sums))


def orphans(stored: DataFrame, seen: DataFrame, keys: Sequence[str], source_system: str | None = None) -> DataFrame:
    """Stored rows of one source system that the current run did not bring."""
    rows = stored if source_system is None else stored.filter(F.col("source_system") == source_system)
    return rows.join(seen.select(*keys), list(keys), "left_anti")


def cascade(capsules: DataFrame, columns: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of orphaned tables, and edges that touch one (each once)."""
    gone = capsules.select(F.col("urn").alias("capsule_urn"))
    lost_columns = columns.join(gone, "capsule_urn", "left_semi")
    out = edges.join(gone.withColumnRenamed("capsule_urn", "source_urn"), "source_urn", "left_semi").select(*edges.columns)
    into = edges.join(gone.withColumnRenamed("capsule_urn", "target_urn"), "target_urn", "left_semi").select(*edges.columns)
    return lost_columns, out.union(into).distinct()


def without_ingestion(stored: DataFrame, ingestion_id: str) -> DataFrame:
    """A snapshot without the rows one ingestion brought."""
    return stored.filter(~F.col("ingestion_id").eqNullSafe(ingestion_id))


def get_or_create(stored: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """Stored rows plus one new row for every name not yet known."""
    fresh = names.select(key).filter(F.col(key).isNotNull()).distinct().join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert_violations(stored: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Open violations by (rule, capsule, column): seen again refreshes ``detected_at``; new ones open.

    stored (rule_id, capsule_urn, column_urn, severity, status, detected_at,
    ingestion_id, resolved_at, resolved_by); found lacks status, detected_at
    and the resolved fields.  Closed violations stay as they are.
    """
    opened = F.col("status") == "open"
    incoming = one_per_key(found, ["rule_id", "capsule_urn", "column_urn"]).withColumns({
        "status": F.lit("open"), "detected_at": F.lit(now).cast("timestamp_ntz"),
        "resolved_at": F.lit(None).cast("timestamp_ntz"), "resolved_by": F.lit(None).cast("string"),
    }).select(*stored.columns)
    merged = upsert(stored.filter(opened), incoming, ["rule_id", "capsule_urn", "column_urn"])
    return merged.unionByName(stored.filter(~opened).withColumn("_change", F.lit(UNCHANGED)))


def auto_resolve(stored: DataFrame, active: DataFrame, ingestion_id: str, now: str, key: str = "id") -> DataFrame:
    """Open violations of other ingestions that are no longer found become resolved.

    A violation without ingestion is left alone.
    """
    known = active.select(key).distinct().withColumn("_active", F.lit(True))
    rows = stored.join(known, key, "left")
    stale = (F.col("status") == "open") & (F.col("ingestion_id") != ingestion_id) & F.col("_active").isNull()
    stale = F.coalesce(stale, F.lit(False))
    return rows.withColumns({
        "status": F.when(stale, "resolved").otherwise(F.col("status")),
        "resolved_at": F.when(stale, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("resolved_at")),
        "resolved_by": F.when(stale, "auto_resolved").otherwise(F.col("resolved_by")),
    }).drop("_active").select(*stored.columns)


def set_status(stored: DataFrame, ids: DataFrame, status: str, now: str, resolved_by: str | None = None, key: str = "id") -> DataFrame:
    """Status of a batch of violations; resolved and false_positive stamp who and when."""
    rows = stored.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    closing = hit & F.lit(status in ("resolved", "false_positive"))
    return rows.withColumns({
        "status": F.when(hit, status).otherwise(F.col("status")),
        "resolved_at": F.when(closing, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("resolved_at")),
        "resolved_by": F.when(closing, F.lit(resolved_by)).otherwise(F.col("resolved_by")),
    }).drop("_hit").select(*stored.columns)


def write_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """Write a snapshot beside earlier ones; readers switch by name, nothing is overwritten."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")


def upsert_rules(stored: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules by ``rule_id``: (rows with ``_change``, (created, updated, total) of the sync). Rules that are no longer declared stay as they are."""
    changed = upsert(stored, one_per_key(declared, ["rule_id"]), ["rule_id"])
    counts = changed.agg(
        F.count_if(F.col("_change") == CREATED).alias("created"), F.count_if(F.col("_change") == UPDATED).alias("updated"), F.count_if(F.col("_change") != MISSING).alias("total")
    )
    return changed, counts


def upsert_orchestration(stored: Mapping[str, DataFrame], incoming: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Workflows, tasks, their edges and column mappings of a run merged into those stored, each by its key; ``_change`` marks what happened."""
    out = {}
    for name, keys in ORCHESTRATION_KEYS.items():
        if name in incoming:
            out[name] = upsert(stored[name], one_per_key(incoming[name].select(*stored[name].columns), keys), keys)
    return out


#: what identifies a row of each orchestration table
ORCHESTRATION_KEYS = {
    "workflows": ["urn"], "tasks": ["task_urn"], "task_edges": ["source_urn", "target_urn", "edge_type"], "data_edges": ["task_urn", "capsule_urn", "edge_type"],
    "column_mappings": ["task_urn", "source_column_urn", "target_column_urn"],
}
