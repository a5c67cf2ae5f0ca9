"""Service-level breaches, retention, and schema history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure(rows: DataFrame, subject: str, updated: str, complete: Column, good: Column) -> DataFrame:
    """(subject, last_update, row_count, completeness, quality_score) per subject."""
    return rows.groupBy(F.col(subject).alias("subject")).agg(
        F.max(updated).alias("last_update"), F.count("*").alias("row_count"),
        F.avg(complete.cast("int")).alias("completeness"), F.avg(good.cast("int")).alias("quality_score"),
    )


def breaches(contracts: DataFrame, measured: DataFrame, now: str) -> DataFrame:
    """Incident rows (subject, incident_type, sla_target, actual_value, breach_magnitude, severity).

    contracts (subject, freshness_hours, row_count_min, row_count_max,
    completeness_sla, quality_score_sla), any of them null.  The magnitude is
    the relative distance from the target; half of it or more is critical, a
    quarter high, a tenth medium.  A subject never measured counts as zero rows.
    """
    facts = contracts.join(measured, "subject", "left")
    hours = (F.lit(now).cast("timestamp").cast("long") - F.col("last_update").cast("timestamp").cast("long")) / 3600
    count = F.coalesce(F.col("row_count"), F.lit(0)).cast("double")

    def over(kind: str, target: Column, actual: Column, above: bool) -> Column:
        target, actual = target.cast("double"), actual.cast("double")
        broken = actual > target if above else actual < target
        gap = F.when(target != 0, F.abs(actual - target) / target).otherwise(F.abs(actual))
        return F.when(broken, F.struct(F.lit(kind).alias("incident_type"), target.alias("sla_target"), F.round(actual, 6).alias("actual_value"), F.round(gap, 6).alias("breach_magnitude")))

    found = F.array_compact(F.array(
        over("freshness", F.col("freshness_hours"), hours, True),
        over("row_count_low", F.col("row_count_min"), count, False),
        over("row_count_high", F.col("row_count_max"), count, True),
        over("completeness", F.col("completeness_sla"), F.col("completeness"), False),
        over("quality", F.col("quality_score_sla"), F.col("quality_score"), False),
    ))
    rows = facts.select("subject", F.explode(found).alias("b")).select("subject", "b.*")
    m = F.col("breach_magnitude")
    return rows.withColumn("severity", F.when(m >= 0.5, "critical").when(m >= 0.25, "high").when(m >= 0.1, "medium").otherwise("low"))


def incident_times(incidents: DataFrame) -> DataFrame:
    """Hours from the start of a breach to its detection and from there to its resolution."""
    gap = lambda a, b: (F.col(b).cast("timestamp").cast("long") - F.col(a).cast("timestamp").cast("long")) / 3600
    return incidents.withColumn("hours_to_detect", gap("breach_started_at", "detected_at")).withColumn("hours_to_resolve", gap("detected_at", "resolved_at"))


def past_retention(rows: DataFrame, ts: str, now: str, days: int, hold: Column | None = None) -> DataFrame:
    """Rows older than the retention period and not on legal hold; the cut-off is a literal, so it is pushed down."""
    cut = F.expr(f"timestamp_ntz'{now}' - interval {int(days)} days")
    old = rows.filter(F.col(ts) < cut)
    return old if hold is None else old.filter(~F.coalesce(hold, F.lit(False)))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(capsule_urn, column_urn, change): columns added, removed or of another type."""
    a = old.select(F.col("urn").alias("column_urn"), F.col("capsule_urn").alias("c0"), F.coalesce("data_type", F.lit("")).alias("t0"))
    b = new.select(F.col("urn").alias("column_urn"), F.col("capsule_urn").alias("c1"), F.coalesce("data_type", F.lit("")).alias("t1"))
    change = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").when(F.col("t0") != F.col("t1"), "retyped")
    both = a.join(b, "column_urn", "full_outer")
    return both.select(F.coalesce("c0", "c1").alias("capsule_urn"), "column_urn", change.alias("change")).filter(F.col("change").isNotNull())


def new_versions(changes: DataFrame, current: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One version row per changed table.

    The type is created, deleted or schema_change; removed or retyped columns
    break.  ``current`` (capsule_urn, version_number) numbers the new version.
    """
    kinds = ("added", "removed", "retyped")
    per_table = changes.groupBy("capsule_urn").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    tables = lambda df, flag: df.select("capsule_urn").distinct().withColumn(flag, F.lit(True))
    rows = per_table.join(tables(old, "_old"), "capsule_urn", "left").join(tables(new, "_new"), "capsule_urn", "left")
    rows = rows.join(current.groupBy("capsule_urn").agg(F.max("version_number").alias("_last")), "capsule_urn", "left")
    change_type = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").otherwise("schema_change")
    return rows.select(
        "capsule_urn", (F.coalesce("_last", F.lit(0)) + 1).alias("version_number"), change_type.alias("change_type"),
        ((F.col("removed") > 0) | (F.col("retyped") > 0)).alias("breaking_change"),
        F.concat_ws(", ", *[F.concat(F.col(k).cast("string"), F.lit(f" {k}")) for k in kinds]).alias("change_summary"),
    )
