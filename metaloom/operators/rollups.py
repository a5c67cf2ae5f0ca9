"""Counts, catalog roll-ups and the enrichment joins they need.

Children are always reduced to one row per key before they are joined, so no
join multiplies another and hot keys are combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions.classify import dependency_type, present
from metaloom.operators.filters import CRITICAL_TASK


def count_by(df: DataFrame, key: str, null_as: str | None = None, condition: Column | None = None) -> DataFrame:
    """(key, n): row counts per value; null counts under ``null_as`` when given."""
    rows = df if condition is None else df.filter(condition)
    value = F.col(key) if null_as is None else F.coalesce(F.col(key), F.lit(null_as))
    return rows.groupBy(value.alias(key)).agg(F.count("*").alias("n"))


def counts_by_each(df: DataFrame, keys: Sequence[str], null_as: str = "unknown") -> DataFrame:
    """(dimension, value, n) for several keys in one pass over ``df``."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit(null_as)).alias("value")) for k in keys]))
    return df.select(cells.alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def counts_per_parent(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(parent, child, n): how many rows of each child table belong to a parent."""
    parts = [df.groupBy(F.col(key).alias("parent")).agg(F.count("*").alias("n")).select("parent", F.lit(name).alias("child"), "n") for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def capsule_stats(capsules: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: tables, tables with PII, documented tables, mean columns, documentation share."""
    per_table = columns.groupBy("capsule_urn").agg(F.count("*").alias("n"), F.bool_or(F.col("pii_type").isNotNull()).alias("pii"))
    known = capsules.select(F.col("urn").alias("capsule_urn"), F.lit(True).alias("known"))
    of_columns = per_table.join(known, "capsule_urn", "left").agg(
        F.round(F.avg("n"), 1).alias("average_column_count"), F.count_if(F.col("pii") & F.col("known")).alias("capsules_with_pii")
    )
    documented = F.count_if(present(F.col("description")))
    totals = capsules.agg(
        F.count("*").alias("total_capsules"), documented.alias("capsules_with_docs"),
        F.round(F.when(F.count("*") > 0, documented / F.count("*") * 100).otherwise(0.0), 1).alias("average_doc_coverage"),
    )
    # two one-row results side by side
    return totals.withColumn("_k", F.lit(1)).join(of_columns.withColumn("_k", F.lit(1)), "_k").drop("_k")


def members_per_domain(domains: DataFrame, members: DataFrame) -> DataFrame:
    """(domain, parent, members) with zero for empty domains."""
    counts = members.groupBy("domain").agg(F.count("*").alias("members"))
    return domains.join(counts, "domain", "left").na.fill(0, ["members"])


def product_stats(products: DataFrame, members: DataFrame) -> DataFrame:
    """One row: products, memberships and their mean."""
    n = products.agg(F.count("*").alias("products"), F.lit(1).alias("_k"))
    m = members.agg(F.count("*").alias("memberships"), F.lit(1).alias("_k"))
    mean = F.when(F.col("products") > 0, F.col("memberships") / F.col("products")).otherwise(0.0)
    return n.join(m, "_k").select("products", "memberships", F.round(mean, 6).alias("average_members"))


def with_rules(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations with the attributes of their rule."""
    return violations.join(rules, "rule_id")


def dependency_summary(dependencies: DataFrame) -> DataFrame:
    """One row over task dependencies: total, active, distinct workflows, critical."""
    active = F.col("is_active")
    return dependencies.agg(
        F.count("*").alias("total_dependencies"), F.count_if(active).alias("active_dependencies"),
        F.count_distinct(F.when(active, F.col("dag_id"))).alias("unique_dags"),
        F.count_if(active & (F.col("criticality_score") >= CRITICAL_TASK)).alias("critical_tasks"),
    )


def change_outcomes(changes: DataFrame) -> DataFrame:
    """Per change type: count, success rate of judged changes, mean downtime of successful ones."""
    done = F.col("success")
    return changes.groupBy("change_type").agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg(done.cast("int")), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("actual_downtime_seconds"))), F.lit(0.0)), 4).alias("avg_downtime_seconds"),
    )


def common_issues(changes: DataFrame, issues: Column, k: int = 10) -> DataFrame:
    """The ``k`` most frequent issues; ties go to the smaller text."""
    counted = changes.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "issue").limit(k)


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total_alerts"), F.count_if(~F.col("resolved")).alias("unresolved_alerts"),
        F.count_if(~F.col("resolved") & (F.col("severity") == "critical")).alias("critical_unresolved"),
        F.count_if("resolved").alias("resolved_alerts"),
    )


def alerts_by_urgency(alerts: DataFrame) -> DataFrame:
    """Unresolved alerts in order: critical, high, medium, low, then newest first."""
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return alerts.filter(~F.col("resolved")).withColumn("rank", rank).orderBy("rank", F.desc("created_at"), "id")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, as a partial aggregate (no sort of the group)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps only ``k`` per task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


# ---------------------------------------------------------------------------
# Catalog summaries
# ---------------------------------------------------------------------------


def _per(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(F.col(key).alias("urn")).agg(*[c.alias(name) for name, c in aggregates.items()])


def capsule_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with counts from every metadata table.

    The mean quality score is the mean over column profiles, not weighted by
    the number of siblings in other tables.
    """
    kind = F.col("constraint_type")
    parts = [
        _per(tables["columns"], "capsule_urn", column_count=F.count("*")),
        _per(tables["indexes"], "capsule_urn", index_count=F.count("*")),
        _per(tables["constraints"], "capsule_urn", pk_count=F.count_if(kind == "primary_key"), fk_count=F.count_if(kind == "foreign_key")),
        _per(tables["capsule_terms"], "capsule_urn", business_term_count=F.count_distinct("term")),
        _per(tables["quality_rules"], "capsule_urn", quality_rule_count=F.count("*"), enabled_quality_rule_count=F.count_if("is_enabled")),
        _per(tables["profiles"], "capsule_urn", avg_column_quality_score=F.round(F.avg((F.col("completeness_score") + F.col("validity_score") + F.col("uniqueness_score")) / 3.0), 6)),
        _per(tables["policies"], "capsule_urn", highest_sensitivity=F.max("sensitivity_level"), has_masking_rules=F.bool_or("requires_masking")),
        _per(tables["masking_rules"], "capsule_urn", masking_rule_count=F.count("*")),
        _per(tables["versions"], "capsule_urn", version_count=F.count("*")),
        _per(tables["code"], "capsule_urn", transformation_code_count=F.count("*")),
        _per(tables["contracts"], "capsule_urn", freshness_sla=F.max("freshness_hours"), quality_score_sla=F.max("quality_score_sla"), contract_status=F.max("contract_status")),
        _per(tables["edges"], "target_urn", upstream_count=F.count_distinct("source_urn")),
        _per(tables["edges"], "source_urn", downstream_count=F.count_distinct("target_urn")),
    ]
    base = tables["capsules"].select("urn", "name", "capsule_type", "layer", "description")
    joined = reduce(lambda left, part: left.join(part, "urn", "left"), parts, base)
    return joined.na.fill(0, [c for c in joined.columns if c.endswith("_count")])


def column_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: constraints, terms, quality scores, masking."""
    kind = F.col("constraint_type")
    parts = [
        _per(tables["constraints"], "column_urn", is_primary_key=F.count_if(kind == "primary_key"), is_foreign_key=F.count_if(kind == "foreign_key"),
             is_unique=F.count_if(kind == "unique"), is_not_null=F.count_if(kind == "not_null")),
        _per(tables["column_terms"], "column_urn", business_term_count=F.count_distinct("term")),
        tables["profiles"].select(
            F.col("column_urn").alias("urn"), F.round((F.col("completeness_score") + F.col("validity_score") + F.col("uniqueness_score")) / 3.0, 6).alias("overall_quality_score"),
            "completeness_score", "validity_score", "uniqueness_score", "null_percentage", "unique_percentage",
        ),
        _per(tables["masking_rules"], "column_urn", masking_rule_count=F.count("*")),
    ]
    owner = tables["capsules"].select(F.col("urn").alias("capsule_urn"), F.col("name").alias("capsule_name"))
    base = tables["columns"].select("urn", "name", "data_type", "capsule_urn").join(owner, "capsule_urn")
    joined = reduce(lambda left, part: left.join(part, "urn", "left"), parts, base)
    return joined.na.fill(0, ["is_primary_key", "is_foreign_key", "is_unique", "is_not_null", "business_term_count", "masking_rule_count"])


# ---------------------------------------------------------------------------
# Enrichment joins
# ---------------------------------------------------------------------------


def tasks_of_capsules(task_edges: DataFrame, tasks: DataFrame, workflows: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges with their task and workflow; ``edge_type`` picks producers or consumers."""
    edges = task_edges if edge_type is None else task_edges.filter(F.col("edge_type") == edge_type)
    named = tasks.select("task_urn", F.col("name").alias("task_id"))
    owners = workflows.select(F.col("urn").alias("pipeline_urn"), F.col("name").alias("dag_id"), "schedule_interval")
    return edges.join(named, "task_urn").join(owners, "pipeline_urn").withColumn("dependency_type", dependency_type(F.col("edge_type")))


def described_edges(column_edges: DataFrame, columns: DataFrame, end: str = "source_column_urn") -> DataFrame:
    """Column edges with name, type and table of the column at ``end``."""
    facts = columns.select(F.col("urn").alias(end), F.col("name").alias("column_name"), "data_type", "capsule_urn")
    return column_edges.join(facts, end)


def footprint(task_edges: DataFrame) -> DataFrame:
    """(pipeline, edge_type, capsules, edges): the data a workflow touches, one join-free pass."""
    return task_edges.groupBy("pipeline_urn", "edge_type").agg(F.count_distinct("capsule_urn").alias("capsules"), F.count("*").alias("edges"))


def footprint_rows(task_edges: DataFrame, capsules: DataFrame) -> DataFrame:
    """The tables that a workflow touches as rows: pipeline_urn, edge_type, capsule_urn, name, layer, and by how many of its tasks."""
    touched = task_edges.groupBy("pipeline_urn", "edge_type", "capsule_urn").agg(F.count_distinct("task_urn").alias("tasks"))
    return touched.join(capsules.select(F.col("urn").alias("capsule_urn"), "name", "layer"), "capsule_urn", "left")


def resolve_columns(names: DataFrame, capsules: DataFrame, columns: DataFrame) -> DataFrame:
    """Resolve ``table.column`` and ``schema.table.column`` names to column URNs.

    Table and schema compare without case, the column exactly; of several
    tables the one with the smallest URN decides, and the name stays
    unresolved when that table lacks the column.
    """
    parts = F.split("qualified_name", r"\.")
    n = F.size(parts)
    split = names.filter(n.isin(2, 3)).select(
        "qualified_name", F.when(n == 3, F.lower(parts[0])).alias("_schema"),
        F.lower(F.get(parts, n - 2)).alias("_table"), F.get(parts, n - 1).alias("name"),
    )
    tables = capsules.groupBy(F.lower("name").alias("_table"), F.lower("schema_name").alias("_s")).agg(F.min("urn").alias("capsule_urn"))
    with_schema = split.filter(F.col("_schema").isNotNull()).join(tables, (split["_table"] == tables["_table"]) & (split["_schema"] == tables["_s"]))
    anywhere = tables.groupBy("_table").agg(F.min("capsule_urn").alias("capsule_urn"))
    without = split.filter(F.col("_schema").isNull()).join(anywhere, "_table")
    chosen = with_schema.select("qualified_name", "capsule_urn", "name").unionByName(without.select("qualified_name", "capsule_urn", "name"))
    return chosen.join(columns.select("capsule_urn", "name", F.col("urn").alias("column_urn")), ["capsule_urn", "name"]).select("qualified_name", "column_urn")
