"""Derived flags of catalog rows, a family for each kind of row: name -> condition over the row's own columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.classify import present
from metaloom.operators import filters

Flags = dict[str, Column]


def _some(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def columns() -> Flags:
    """Over pii_type, semantic_type and ``constraint_types``, the kinds of constraints a column has."""
    kinds = F.coalesce("constraint_types", F.array().cast("array<string>"))
    return {
        "is_pii": F.coalesce(F.col("semantic_type") == "pii", F.lit(False)) | F.col("pii_type").isNotNull(), "has_constraints": F.size(kinds) > 0,
        "is_primary_key": F.array_contains(kinds, "primary_key"), "is_foreign_key": F.array_contains(kinds, "foreign_key"),
    }


def capsules() -> Flags:
    """Over n_columns, n_pii and n_indexes."""
    return {"has_pii": F.col("n_pii") > 0, "has_columns": F.col("n_columns") > 0, "is_indexed": F.col("n_indexes") > 0}


def contracts(today: str) -> Flags:
    past = F.coalesce(F.col("deprecation_date") <= F.lit(today).cast("date"), F.lit(False))
    return {
        "is_active": F.col("contract_status") == "active", "is_deprecated": (F.col("contract_status") == "deprecated") | past,
        "has_freshness_sla": F.col("freshness_hours").isNotNull(),
        "has_completeness_sla": F.col("completeness_sla").isNotNull() | F.col("row_count_min").isNotNull() | F.col("row_count_max").isNotNull(),
        "has_quality_sla": F.col("quality_score_sla").isNotNull() | _some("critical_rules"),
    }


def incidents() -> Flags:
    return {
        "is_open": F.col("incident_status").isin(filters.OPEN_INCIDENT), "is_resolved": F.col("incident_status").isin(filters.CLOSED_INCIDENT),
        "has_impact_assessment": _some("affected_consumers") | present(F.col("downstream_impact")),
    }


def incident_times() -> dict[str, Column]:
    """Seconds from breach to detection and from detection to resolution; null where an end is missing."""
    seconds = lambda a, b: F.unix_timestamp(F.col(b).cast("timestamp")) - F.unix_timestamp(F.col(a).cast("timestamp"))
    return {"time_to_detect": seconds("breach_started_at", "detected_at"), "time_to_resolve": seconds("detected_at", "resolved_at")}


def quality_rules() -> Flags:
    return {"is_capsule_rule": F.col("capsule_urn").isNotNull(), "is_column_rule": F.col("column_urn").isNotNull()}


def versions() -> Flags:
    named = lambda *names: F.greatest(*[F.coalesce(present(F.col(n)), F.lit(False)) for n in names])
    return {
        "has_git_context": named("git_commit_sha", "git_branch", "git_tag"), "is_breaking_change": F.col("breaking_change"),
        "has_deployment_info": F.col("deployed_at").isNotNull() | named("deployed_by", "deployment_context"),
    }


def profiles() -> Flags:
    given = lambda a, b: F.col(a).isNotNull() | F.col(b).isNotNull()
    return {"is_numeric_profile": given("mean_value", "median_value"), "is_string_profile": given("min_length", "max_length"), "has_temporal_data": given("earliest_timestamp", "latest_timestamp")}


def terms() -> Flags:
    return {"is_approved": F.col("approval_status") == "approved"}
