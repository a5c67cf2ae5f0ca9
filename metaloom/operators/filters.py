"""Predicates over the catalog tables, one function per table.

Each returns a Column for ``DataFrame.filter``; arguments left out do not
restrict.  Dates that mean "today" are parameters.  ``matches`` evaluates many
named predicates in one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: lowest criticality of a critical task dependency (fixed value)
CRITICAL_TASK = 0.7


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equal(**values: object) -> Column:
    """All given columns equal their values; None does not restrict."""
    return all_of([F.col(name) == value for name, value in values.items() if value is not None])


def csv_list(c: str) -> Column:
    """A comma-separated text as an array, empty text as an empty array."""
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != "")


def contains_text(text: str, *columns: str) -> Column:
    """Case-insensitive search for literal ``text`` in any of the columns."""
    found = [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found)


def matches(df: DataFrame, key: str, predicates: Mapping[str, Column]) -> DataFrame:
    """(key, filter): the names of all predicates a row meets, in one scan."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in predicates.items()]))
    return df.select(F.col(key), F.explode(names).alias("filter"))


def capsules(search: str | None = None, has_pii: bool | None = None, layer: str | None = None,
             capsule_type: str | None = None, domain: str | None = None, source_system: str | None = None) -> Column:
    """The first given of search, PII, layer, type, domain, source system decides."""
    if search is not None:
        return contains_text(search, "name", "description")
    if has_pii is not None:
        return F.col("has_pii") == has_pii
    for name, value in (("layer", layer), ("capsule_type", capsule_type), ("domain", domain), ("source_system", source_system)):
        if value is not None:
            return F.col(name) == value
    return F.lit(True)


def columns(capsule_urn: str | None = None, pii: bool = False, pii_type: str | None = None, semantic_type: str | None = None) -> Column:
    return equal(capsule_urn=capsule_urn, pii_type=pii_type, semantic_type=semantic_type) & (
        F.col("pii_type").isNotNull() if pii else F.lit(True)
    )


def policies(today: str | None = None, active: bool = False, review_due: bool = False, sensitivity_level: str | None = None,
             framework: str | None = None, capsule_urn: str | None = None, column_urn: str | None = None) -> Column:
    conditions = [equal(sensitivity_level=sensitivity_level, capsule_urn=capsule_urn, column_urn=column_urn)]
    if active:
        conditions += [F.col("policy_status") == "active"]
    if review_due:
        conditions += [F.col("next_review_date") <= F.lit(today).cast("date")]
    if framework is not None:
        conditions += [F.array_contains(csv_list("frameworks_csv"), framework)]
    return all_of(conditions)


def policy_in_force(today: str) -> Column:
    """Active and inside its effective dates."""
    day = F.lit(today).cast("date")
    return (
        (F.col("policy_status") == "active")
        & (F.col("effective_from").isNull() | (day >= F.col("effective_from")))
        & (F.col("effective_to").isNull() | (day <= F.col("effective_to")))
    )


#: tags that mark a policy as one about personal data (fixed values)
PII_POLICY_TAGS = ["gdpr", "ccpa", "pii", "personal_data"]


def pii_policy() -> Column:
    return F.exists(csv_list("classification_csv"), lambda t: F.lower(t).isin(PII_POLICY_TAGS))


def contracts(contract_status: str | None = None, contract_owner: str | None = None, support_level: str | None = None,
              deprecated_on: str | None = None, has_freshness: bool = False, has_completeness: bool = False, has_quality: bool = False) -> Column:
    conditions = [equal(contract_status=contract_status, contract_owner=contract_owner, support_level=support_level)]
    if deprecated_on is not None:
        past = F.coalesce(F.col("deprecation_date") <= F.lit(deprecated_on).cast("date"), F.lit(False))
        conditions.append((F.col("contract_status") == "deprecated") | past)
    if has_freshness:
        conditions.append(F.col("freshness_hours").isNotNull())
    if has_completeness:
        conditions.append(F.col("completeness_sla").isNotNull() | F.col("row_count_min").isNotNull())
    if has_quality:
        conditions.append(F.col("quality_score_sla").isNotNull())
    return all_of(conditions)


OPEN_INCIDENT = ["open", "investigating"]
CLOSED_INCIDENT = ["resolved", "closed", "false_positive"]


def incidents(contract_id: str | None = None, capsule_urn: str | None = None, incident_type: str | None = None,
              incident_severity: str | None = None, incident_status: str | None = None, root_cause_category: str | None = None,
              is_open: bool = False, is_resolved: bool = False) -> Column:
    condition = equal(contract_id=contract_id, capsule_urn=capsule_urn, incident_type=incident_type,
                      incident_severity=incident_severity, incident_status=incident_status, root_cause_category=root_cause_category)
    if is_open:
        condition = condition & F.col("incident_status").isin(OPEN_INCIDENT)
    if is_resolved:
        condition = condition & F.col("incident_status").isin(CLOSED_INCIDENT)
    return condition


def quality_rules(capsule_urn: str | None = None, column_urn: str | None = None, rule_type: str | None = None,
                  rule_category: str | None = None, enabled: bool | None = None, blocking: bool | None = None) -> Column:
    return equal(capsule_urn=capsule_urn, column_urn=column_urn, rule_type=rule_type, rule_category=rule_category,
                 is_enabled=enabled, blocking=blocking)


def masking_rules(column_urn: str | None = None, enabled: bool | None = None, masking_method: str | None = None,
                  reversible: bool | None = None, role: str | None = None) -> Column:
    condition = equal(column_urn=column_urn, is_enabled=enabled, masking_method=masking_method, is_reversible=reversible)
    return condition if role is None else condition & applies_to_role(role)


def applies_to_role(role: str) -> Column:
    """A rule without roles applies to all; an exempt role is left out; else the role must be listed."""
    roles, exempt = csv_list("roles_csv"), csv_list("exempt_csv")
    return (F.size(roles) == 0) | (~F.array_contains(exempt, role) & F.array_contains(roles, role))


def constraints(column_urn: str | None = None, constraint_type: str | None = None, referenced_table_urn: str | None = None) -> Column:
    return equal(column_urn=column_urn, constraint_type=constraint_type, referenced_table_urn=referenced_table_urn)


def indexes(capsule_urn: str | None = None, index_type: str | None = None, unique: bool | None = None,
            primary: bool | None = None, column: str | None = None) -> Column:
    condition = equal(capsule_urn=capsule_urn, index_type=index_type, is_unique=unique, is_primary=primary)
    return condition if column is None else condition & F.array_contains(csv_list("column_csv"), column)


def versions(capsule_urn: str | None = None, version_number: int | None = None, change_type: str | None = None,
             git_commit_sha: str | None = None, breaking: bool | None = None) -> Column:
    return equal(capsule_urn=capsule_urn, version_number=version_number, change_type=change_type,
                 git_commit_sha=git_commit_sha, breaking_change=breaking)


def code(capsule_urn: str | None = None, language: str | None = None, git_commit_sha: str | None = None, file_path: str | None = None,
         edge_id: str | None = None) -> Column:
    return equal(capsule_urn=capsule_urn, language=language, git_commit_sha=git_commit_sha, file_path=file_path, edge_id=edge_id)


def terms(domain: str | None = None, category: str | None = None, approval_status: str | None = None) -> Column:
    return equal(domain=domain, category=category, approval_status=approval_status)


def tags(category: str | None = None, sensitivity_level: str | None = None) -> Column:
    return equal(category=category, sensitivity_level=sensitivity_level)


def data_products(domain: str | None = None, owner: str | None = None, status: str | None = None) -> Column:
    return equal(domain=domain, owner=owner, status=status)


def value_domains(domain_type: str | None = None, owner: str | None = None, extensible: bool | None = None) -> Column:
    return equal(domain_type=domain_type, owner=owner, is_extensible=extensible)


def workflows(pipeline_type: str | None = None, source_system: str | None = None, active: bool | None = None,
              paused: bool | None = None, search: str | None = None) -> Column:
    condition = equal(pipeline_type=pipeline_type, source_system=source_system, is_active=active, is_paused=paused)
    return condition if search is None else condition & contains_text(search, "name")


def task_dependencies(dag_id: str | None = None, task_id: str | None = None, capsule_urn: str | None = None,
                      dependency_type: str | None = None, active: bool | None = None, critical: bool = False) -> Column:
    condition = equal(dag_id=dag_id, task_id=task_id, capsule_urn=capsule_urn, dependency_type=dependency_type, is_active=active)
    return condition & (F.col("criticality_score") >= CRITICAL_TASK) if critical else condition


def changes(column_urn: str | None = None, change_type: str | None = None, success: bool | None = None,
            since: str | None = None, until: str | None = None) -> Column:
    conditions = [equal(column_urn=column_urn, change_type=change_type, success=success)]
    if since is not None:
        conditions.append(F.col("change_timestamp") >= F.lit(since))
    if until is not None:
        conditions.append(F.col("change_timestamp") <= F.lit(until))
    return all_of(conditions)


def alerts(alert_type: str | None = None, severity: str | None = None, column_urn: str | None = None,
           resolved: bool | None = None, acknowledged: bool | None = None) -> Column:
    return equal(alert_type=alert_type, severity=severity, column_urn=column_urn, resolved=resolved, acknowledged=acknowledged)


def violations(status: str | None = None, severity: str | None = None, subject: object | None = None,
               ingestion_id: str | None = None, category: str | None = None, rule_set: str | None = None) -> Column:
    """Over violations joined with their rules when ``category`` or ``rule_set`` is given."""
    return equal(status=status, severity=severity, subject=subject, ingestion_id=ingestion_id, category=category, rule_set=rule_set)


def rules(rule_set: str | None = None, category: str | None = None, scope: str | None = None, enabled: bool | None = None) -> Column:
    return equal(rule_set=rule_set, category=category, scope=scope, enabled=enabled)


def owners(owner_type: str | None = None) -> Column:
    return equal(owner_type=owner_type)


def domain_roots() -> Column:
    return F.col("parent").isNull()


def domain_children(parent: str) -> Column:
    return F.col("parent") == parent


def linked(df: DataFrame, key: str, bridge: DataFrame, bridge_key: str, condition: Column | None = None) -> DataFrame:
    """Rows of ``df`` that a bridge row (meeting ``condition``) points at."""
    rows = bridge if condition is None else bridge.filter(condition)
    return df.join(rows.select(F.col(bridge_key).alias(key)), key, "left_semi")


def exists_link(pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """``pairs`` with ``linked``: whether the bridge has a row with the same values in all of the pair's columns."""
    names = pairs.columns
    known = bridge.select(*names).distinct().withColumn("linked", F.lit(True))
    return pairs.join(known, names, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of a listing; the last sort key must be unique."""
    return df.orderBy(*order).offset(offset).limit(limit)
