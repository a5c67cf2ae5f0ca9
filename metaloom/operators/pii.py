"""PII inventory, exposure, tracing and content scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.classify import PII_NAME_PATTERNS, detect_pii, is_masked, pii_severity
from metaloom.operators.lineage import origins, terminals, traverse
from metaloom.staging import new_stage, stage

#: layers where exposed PII matters (fixed values)
CONSUMPTION_LAYERS = ["gold", "marts", "mart", "consumption", "reporting", "analytics"]
SEVERITIES = ["critical", "high", "medium", "low"]

#: what the content scan looks for
CONTENT_PATTERNS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phones": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
    "cards": r"(?:[0-9]{4}[ -]?){3}[0-9]{4}",
    "ips": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
}


def tag_columns(columns: DataFrame, meta: str | None = None, tags: str | None = None, patterns: Mapping[str, Sequence[str]] = PII_NAME_PATTERNS) -> DataFrame:
    """Add ``pii_type`` and ``pii_detected_by`` from metadata, tags and name (``patterns``: type -> patterns of names)."""
    found = detect_pii(F.col("name"), F.col(meta) if meta else None, F.col(tags) if tags else None, patterns)
    return columns.withColumn("_pii", found).select(
        "*", F.col("_pii.pii_type").alias("pii_type"), F.col("_pii.detected_by").alias("pii_detected_by")
    ).drop("_pii")


def pii_columns(columns: DataFrame, capsules: DataFrame, pii_type: str | None = None, layer: str | None = None, domain: str | None = None) -> DataFrame:
    """Tagged columns with their table's name, layer and domain; filters run before the join."""
    tagged = columns.filter(F.col("pii_type").isNotNull())
    if pii_type is not None:
        tagged = tagged.filter(F.col("pii_type") == pii_type)
    tables = capsules.select(F.col("urn").alias("capsule_urn"), F.col("name").alias("capsule_name"), "layer", "domain")
    if layer is not None:
        tables = tables.filter(F.col("layer") == layer)
    if domain is not None:
        tables = tables.filter(F.col("domain") == domain)
    return tagged.join(tables, "capsule_urn")


def inventory_by_type(found: DataFrame) -> DataFrame:
    layers = F.array_join(F.array_sort(F.collect_set("layer")), ",")
    return found.groupBy("pii_type").agg(
        F.count("*").alias("column_count"), F.count_distinct("capsule_urn").alias("capsule_count"), layers.alias("layers")
    )


def inventory_by_layer(found: DataFrame) -> DataFrame:
    types = F.array_join(F.array_sort(F.collect_set("pii_type")), ",")
    return found.groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(
        F.count("*").alias("column_count"), F.count_distinct("capsule_urn").alias("capsule_count"), types.alias("pii_types")
    )


def inventory_totals(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("total_pii_columns"),
        F.count_distinct("capsule_urn").alias("capsules_with_pii"),
        F.array_join(F.array_sort(F.collect_set("pii_type")), ",").alias("pii_types_found"),
    )


def exposures(found: DataFrame, layer: str | None = None, severity: str | None = None, meta: Column | None = None) -> DataFrame:
    """Unmasked PII columns in consumption layers with severity, reason and advice."""
    low = F.lower(F.coalesce("layer", F.lit("")))
    rows = found.withColumn("layer", low).filter(F.col("layer").isin([layer] if layer else CONSUMPTION_LAYERS))
    rows = rows.filter(~is_masked(F.col("name"), meta)).withColumn("severity", pii_severity(F.col("pii_type")))
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    return rows.select(
        F.col("urn").alias("column_urn"), F.col("name").alias("column_name"), "pii_type", "capsule_urn", "capsule_name", "layer", "severity",
        F.concat(F.lit("Unmasked "), "pii_type", F.lit(" PII in "), "layer", F.lit(" layer")).alias("reason"),
        F.concat(F.lit("Apply masking, hashing, or encryption to "), "name").alias("recommendation"),
    )


def exposure_breakdown(exposed: DataFrame) -> DataFrame:
    """Counts per severity, zeros included."""
    levels = exposed.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    counts = exposed.groupBy("severity").agg(F.count("*").alias("columns"), F.count_distinct("capsule_urn").alias("capsules"))
    return levels.join(counts, "severity", "left").na.fill(0, ["columns", "capsules"])


def trace(columns: DataFrame, edges: DataFrame, max_depth: int = 10,
          source: str = "source_column_urn", target: str = "target_column_urn") -> DataFrame:
    """Origin, reach and masking of every PII column at once.

    columns (urn, name, pii_type).  One row per PII column: the origin found by
    following the smallest upstream edge, the number of nodes downstream and of
    terminal nodes, and whether every terminal is masked (false without any).
    """
    path = new_stage(columns.sparkSession, "pii_trace")
    edges = stage(edges.select(source, target).distinct(), f"{path}/edges")
    seeds = stage(columns.filter(F.col("pii_type").isNotNull()).select(F.col("urn").alias("seed")), f"{path}/seeds")
    started = origins(edges, seeds, max_depth, source, target)
    reached = traverse(edges, seeds, max_depth=max_depth, source=source, target=target)
    downstream = reached.groupBy("seed").agg(F.count("*").alias("downstream_nodes"))
    names = columns.select(F.col("urn").alias("node"), is_masked(F.col("name"), suffix_only=True).alias("masked"))
    ends = (
        terminals(edges, reached, max_depth, source).join(names, "node")
        .groupBy("seed").agg(F.count("*").alias("consumers"), F.bool_and("masked").alias("masked_at_terminals"))
    )
    return (
        seeds.join(started, "seed", "left").join(downstream, "seed", "left").join(ends, "seed", "left")
        .select(
            F.col("seed").alias("column_urn"), "origin", F.coalesce("hops", F.lit(0)).alias("upstream_hops"),
            F.coalesce("downstream_nodes", F.lit(0)).alias("downstream_nodes"), F.coalesce("consumers", F.lit(0)).alias("consumers"),
            F.coalesce("masked_at_terminals", F.lit(False)).alias("masked_at_terminals"),
        )
    )


def scan_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of personal data found in the whole text of every row."""
    counts = [F.regexp_count(F.col(text), F.lit(p)).alias(kind) for kind, p in CONTENT_PATTERNS.items()]
    return df.select(key, *counts)
