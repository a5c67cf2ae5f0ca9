"""Aggregates, catalog summaries, enrichment joins, ordering and set queries."""

from pyspark.sql import functions as F

from metaloom.operators import filters, pii, rollups
from metaloom.plans.pii_queries import PII_SQL, SEMANTIC_SQL
from metaloom.plans.registry import Catalog, query


def each_sql(view: str, keys) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS dimension, coalesce(CAST({k} AS STRING), 'unknown') AS value, count(*) AS n FROM {view} GROUP BY 2" for k in keys)


def register_each(name: str, view: str, keys) -> None:
    query(name, each_sql(view, keys))(lambda c: rollups.counts_by_each(c.view(view), keys))


register_each("agg1_capsules_by", "v_capsules", ["layer", "capsule_type"])
register_each("agg4_workflows_by", "v_workflows", ["pipeline_type", "source_system"])
register_each("agg4_task_edges_by", "v_task_edges", ["edge_type"])
register_each("agg6_products_by", "v_data_products", ["status"])
register_each("agg8_rules_by", "v_rules", ["category", "rule_set"])
register_each("agg10_dependencies_by", "v_task_dependencies", ["dependency_type", "dag_id"])
register_each("agg12_alerts_by", "v_alerts", ["severity", "alert_type"])


@query("agg2_capsule_stats", f"""
    WITH t AS (SELECT capsule_urn, {PII_SQL} AS pii_type FROM v_columns)
    SELECT (SELECT count(*) FROM v_capsules) AS total_capsules, (SELECT count(*) FROM v_capsules WHERE coalesce(description, '') <> '') AS capsules_with_docs,
      (SELECT round(count(*) FILTER (coalesce(description, '') <> '') / count(*) * 100, 1) FROM v_capsules) AS average_doc_coverage,
      (SELECT round(avg(n), 1) FROM (SELECT count(*) AS n FROM t GROUP BY capsule_urn)) AS average_column_count,
      (SELECT count(DISTINCT capsule_urn) FROM t JOIN v_capsules c ON c.urn = capsule_urn WHERE pii_type IS NOT NULL) AS capsules_with_pii""")
def agg2_capsule_stats(c: Catalog):
    return rollups.capsule_stats(c.view("v_capsules"), pii.tag_columns(c.view("v_columns")))


@query("agg3_columns_by", f"""
    WITH t AS (SELECT *, {SEMANTIC_SQL} AS semantic_type FROM (SELECT *, {PII_SQL} AS pii_type FROM v_columns))
    {each_sql('t', ['pii_type', 'semantic_type', 'data_type'])}""")
def agg3_columns_by(c: Catalog):
    from metaloom.functions.classify import semantic_type

    rows = pii.tag_columns(c.view("v_columns")).withColumn("semantic_type", semantic_type(F.col("name"), F.col("pii_type")))
    return rollups.counts_by_each(rows, ["pii_type", "semantic_type", "data_type"])


@query("agg5_members_per_domain", "SELECT t.domain, t.parent, count(m.capsule_urn) AS members FROM v_domain_tree t LEFT JOIN v_domain_members m ON m.domain = t.domain GROUP BY 1, 2")
def agg5_members_per_domain(c: Catalog):
    return rollups.members_per_domain(c.view("v_domain_tree"), c.view("v_domain_members"))


@query("agg6_product_stats", "SELECT p AS products, m AS memberships, round(m / p, 6) AS average_members FROM (SELECT (SELECT count(*) FROM v_data_products) AS p, (SELECT count(*) FROM v_product_members) AS m)")
def agg6_product_stats(c: Catalog):
    return rollups.product_stats(c.view("v_data_products"), c.view("v_product_members"))


@query("agg7_violations_by_severity", "SELECT severity, status, count(*) AS n FROM v_violations GROUP BY 1, 2")
def agg7_violations_by_severity(c: Catalog):
    return c.view("v_violations").groupBy("severity", "status").agg(F.count("*").alias("n"))


@query("agg7_open_by_category", "SELECT category, count(*) AS n FROM v_violations JOIN v_rules USING (rule_id) WHERE status = 'open' GROUP BY 1")
def agg7_open_by_category(c: Catalog):
    rows = rollups.with_rules(c.view("v_violations").filter("status = 'open'"), c.view("v_rules"))
    return rollups.count_by(rows, "category")


@query("agg9_counts_per_parent", " UNION ALL ".join(
    f"SELECT {k} AS parent, '{n}' AS child, count(*) AS n FROM {v} GROUP BY 1" for n, v, k in (
        ("constraints", "v_constraints", "column_urn"), ("indexes", "v_indexes", "capsule_urn"), ("profiles", "v_profile_runs", "column_urn"),
        ("policies", "v_policies", "capsule_urn"), ("masking_rules", "v_masking_rules", "column_urn"), ("quality_rules", "v_quality_rules", "capsule_urn"),
        ("versions", "v_versions", "capsule_urn"), ("code", "v_code", "capsule_urn"), ("contracts", "v_contracts", "capsule_urn"),
        ("incidents", "v_incidents", "capsule_urn"), ("tags", "v_capsule_tags", "capsule_urn"))))
def agg9_counts_per_parent(c: Catalog):
    v = c.view
    return rollups.counts_per_parent({
        "constraints": (v("v_constraints"), "column_urn"), "indexes": (v("v_indexes"), "capsule_urn"), "profiles": (v("v_profile_runs"), "column_urn"),
        "policies": (v("v_policies"), "capsule_urn"), "masking_rules": (v("v_masking_rules"), "column_urn"), "quality_rules": (v("v_quality_rules"), "capsule_urn"),
        "versions": (v("v_versions"), "capsule_urn"), "code": (v("v_code"), "capsule_urn"), "contracts": (v("v_contracts"), "capsule_urn"),
        "incidents": (v("v_incidents"), "capsule_urn"), "tags": (v("v_capsule_tags"), "capsule_urn"),
    })


@query("agg10_dependency_summary", """
    SELECT count(*) AS total_dependencies, count(*) FILTER (is_active) AS active_dependencies, count(DISTINCT dag_id) FILTER (is_active) AS unique_dags,
      count(*) FILTER (is_active AND criticality_score >= 0.7) AS critical_tasks FROM v_task_dependencies""")
def agg10_dependency_summary(c: Catalog):
    return rollups.dependency_summary(c.view("v_task_dependencies"))


@query("agg11_change_outcomes", """
    SELECT change_type, count(*) AS n, round(coalesce(avg(CAST(success AS INTEGER)), 0), 6) AS success_rate,
      round(coalesce(avg(actual_downtime_seconds) FILTER (success), 0), 4) AS avg_downtime_seconds FROM v_changes GROUP BY 1""")
def agg11_change_outcomes(c: Catalog):
    return rollups.change_outcomes(c.view("v_changes"))


@query("agg11_common_issues", "SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues_csv, ',')) AS issue FROM v_changes WHERE issues_csv IS NOT NULL) GROUP BY 1 ORDER BY n DESC, issue LIMIT 10")
def agg11_common_issues(c: Catalog):
    return rollups.common_issues(c.view("v_changes"), F.split("issues_csv", ","))


@query("agg12_alert_summary", """
    SELECT count(*) AS total_alerts, count(*) FILTER (NOT resolved) AS unresolved_alerts, count(*) FILTER (NOT resolved AND severity = 'critical') AS critical_unresolved,
      count(*) FILTER (resolved) AS resolved_alerts FROM v_alerts""")
def agg12_alert_summary(c: Catalog):
    return rollups.alert_summary(c.view("v_alerts"))


def summary_tables(c: Catalog):
    names = {
        "capsules": "v_capsules", "columns": "v_columns", "indexes": "v_indexes", "constraints": "v_constraints", "capsule_terms": "v_capsule_terms",
        "column_terms": "v_column_terms", "quality_rules": "v_quality_rules", "profiles": "v_profiles", "policies": "v_policies",
        "masking_rules": "v_masking_rules", "versions": "v_versions", "code": "v_code", "contracts": "v_contracts", "edges": "v_capsule_edges",
    }
    return {k: c.view(v) for k, v in names.items()}


CAPSULE_SUMMARY_SQL = """
    SELECT c.urn, c.name, c.capsule_type, c.layer, c.description,
      (SELECT count(*) FROM v_columns x WHERE x.capsule_urn = c.urn) AS column_count, (SELECT count(*) FROM v_indexes x WHERE x.capsule_urn = c.urn) AS index_count,
      (SELECT count(*) FROM v_constraints x WHERE x.capsule_urn = c.urn AND constraint_type = 'primary_key') AS pk_count,
      (SELECT count(*) FROM v_constraints x WHERE x.capsule_urn = c.urn AND constraint_type = 'foreign_key') AS fk_count,
      (SELECT count(DISTINCT term) FROM v_capsule_terms x WHERE x.capsule_urn = c.urn) AS business_term_count,
      (SELECT count(*) FROM v_quality_rules x WHERE x.capsule_urn = c.urn) AS quality_rule_count,
      (SELECT count(*) FROM v_quality_rules x WHERE x.capsule_urn = c.urn AND is_enabled) AS enabled_quality_rule_count,
      (SELECT round(avg((completeness_score + validity_score + uniqueness_score) / 3.0), 6) FROM v_profiles x WHERE x.capsule_urn = c.urn) AS avg_column_quality_score,
      (SELECT max(sensitivity_level) FROM v_policies x WHERE x.capsule_urn = c.urn) AS highest_sensitivity,
      (SELECT bool_or(requires_masking) FROM v_policies x WHERE x.capsule_urn = c.urn) AS has_masking_rules,
      (SELECT count(*) FROM v_masking_rules x WHERE x.capsule_urn = c.urn) AS masking_rule_count, (SELECT count(*) FROM v_versions x WHERE x.capsule_urn = c.urn) AS version_count,
      (SELECT count(*) FROM v_code x WHERE x.capsule_urn = c.urn) AS transformation_code_count,
      (SELECT max(freshness_hours) FROM v_contracts x WHERE x.capsule_urn = c.urn) AS freshness_sla, (SELECT max(quality_score_sla) FROM v_contracts x WHERE x.capsule_urn = c.urn) AS quality_score_sla,
      (SELECT max(contract_status) FROM v_contracts x WHERE x.capsule_urn = c.urn) AS contract_status,
      (SELECT count(DISTINCT source_urn) FROM v_capsule_edges x WHERE x.target_urn = c.urn) AS upstream_count,
      (SELECT count(DISTINCT target_urn) FROM v_capsule_edges x WHERE x.source_urn = c.urn) AS downstream_count
    FROM v_capsules c"""
COLUMN_SUMMARY_SQL = """
    SELECT c.urn, c.name, c.data_type, c.capsule_urn, t.name AS capsule_name,
      coalesce(k.pk, 0) AS is_primary_key, coalesce(k.fk, 0) AS is_foreign_key, coalesce(k.uq, 0) AS is_unique, coalesce(k.nn, 0) AS is_not_null,
      coalesce(b.n, 0) AS business_term_count, round((p.completeness_score + p.validity_score + p.uniqueness_score) / 3.0, 6) AS overall_quality_score,
      p.completeness_score, p.validity_score, p.uniqueness_score, p.null_percentage, p.unique_percentage, coalesce(m.n, 0) AS masking_rule_count
    FROM v_columns c JOIN v_capsules t ON t.urn = c.capsule_urn
    LEFT JOIN (SELECT column_urn, count(*) FILTER (constraint_type = 'primary_key') AS pk, count(*) FILTER (constraint_type = 'foreign_key') AS fk,
      count(*) FILTER (constraint_type = 'unique') AS uq, count(*) FILTER (constraint_type = 'not_null') AS nn FROM v_constraints GROUP BY 1) k ON k.column_urn = c.urn
    LEFT JOIN (SELECT column_urn, count(DISTINCT term) AS n FROM v_column_terms GROUP BY 1) b ON b.column_urn = c.urn
    LEFT JOIN v_profiles p ON p.column_urn = c.urn LEFT JOIN (SELECT column_urn, count(*) AS n FROM v_masking_rules GROUP BY 1) m ON m.column_urn = c.urn"""


@query("agg13_capsule_catalog", CAPSULE_SUMMARY_SQL)
def agg13_capsule_catalog(c: Catalog):
    return rollups.capsule_summary(summary_tables(c))


@query("agg14_column_catalog", COLUMN_SUMMARY_SQL)
def agg14_column_catalog(c: Catalog):
    return rollups.column_summary(summary_tables(c))


@query("agg15_row_count", "SELECT count(*) AS n FROM lineitem")
def agg15_row_count(c: Catalog):
    return c.table("lineitem").agg(F.count("*").alias("n"))


@query("flt25_catalog_filters", f"""
    WITH s AS ({CAPSULE_SUMMARY_SQL}), k AS ({COLUMN_SUMMARY_SQL})
    SELECT 'gold' AS filter, urn FROM s WHERE layer = 'gold' UNION ALL SELECT 'model', urn FROM s WHERE capsule_type = 'model'
    UNION ALL SELECT 'active_contract', urn FROM s WHERE contract_status = 'active' UNION ALL SELECT 'has_rules', urn FROM s WHERE quality_rule_count > 0
    UNION ALL SELECT 'has_masking', urn FROM s WHERE has_masking_rules UNION ALL SELECT 'is_pk', urn FROM k WHERE is_primary_key > 0 UNION ALL SELECT 'decimal', urn FROM k WHERE data_type = 'DECIMAL'""")
def flt25_catalog_filters(c: Catalog):
    t = summary_tables(c)
    a = filters.matches(rollups.capsule_summary(t), "urn", {
        "gold": F.col("layer") == "gold", "model": F.col("capsule_type") == "model", "active_contract": F.col("contract_status") == "active",
        "has_rules": F.col("quality_rule_count") > 0, "has_masking": F.col("has_masking_rules"),
    })
    return a.unionByName(filters.matches(rollups.column_summary(t), "urn", {"is_pk": F.col("is_primary_key") > 0, "decimal": F.col("data_type") == "DECIMAL"}))


# ---------------------------------------------------------------- joins


@query("j1_producers_consumers", """
    SELECT e.capsule_urn, e.edge_type, e.task_urn, t.name AS task_id, w.name AS dag_id FROM v_task_edges e
    JOIN v_tasks t ON t.task_urn = e.task_urn JOIN v_workflows w ON w.urn = t.pipeline_urn WHERE e.edge_type IN ('produces', 'consumes')""")
def j1_producers_consumers(c: Catalog):
    edges = c.view("v_task_edges").filter(F.col("edge_type").isin("produces", "consumes"))
    return rollups.tasks_of_capsules(edges, c.view("v_tasks"), c.view("v_workflows")).select("capsule_urn", "edge_type", "task_urn", "task_id", "dag_id")


@query("j2_tasks_of_capsule", """
    SELECT w.name AS dag_id, t.name AS task_id, e.capsule_urn, CASE e.edge_type WHEN 'produces' THEN 'write' WHEN 'transforms' THEN 'transform' ELSE 'read' END AS dependency_type,
      w.schedule_interval, round(e.criticality_score, 6) AS criticality_score FROM v_task_edges e JOIN v_tasks t ON t.task_urn = e.task_urn JOIN v_workflows w ON w.urn = t.pipeline_urn""")
def j2_tasks_of_capsule(c: Catalog):
    rows = rollups.tasks_of_capsules(c.view("v_task_edges"), c.view("v_tasks"), c.view("v_workflows"))
    return rows.select("dag_id", "task_id", "capsule_urn", "dependency_type", "schedule_interval", F.round("criticality_score", 6).alias("criticality_score"))


@query("j3_described_edges", """
    SELECT e.source_column_urn, e.target_column_urn, e.transformation_type, n.name AS column_name, n.data_type, n.capsule_urn
    FROM v_column_edges e JOIN v_column_nodes n ON n.urn = e.source_column_urn""")
def j3_described_edges(c: Catalog):
    rows = rollups.described_edges(c.view("v_column_edges"), c.view("v_column_nodes"))
    return rows.select("source_column_urn", "target_column_urn", "transformation_type", "column_name", "data_type", "capsule_urn")


@query("j4_capsules_with_pii", f"SELECT urn, name, layer FROM v_capsules WHERE urn IN (SELECT capsule_urn FROM v_columns WHERE {PII_SQL} IS NOT NULL)")
def j4_capsules_with_pii(c: Catalog):
    tagged = pii.tag_columns(c.view("v_columns")).filter("pii_type is not null")
    return filters.linked(c.view("v_capsules"), "urn", tagged, "capsule_urn").select("urn", "name", "layer")


@query("j5_orphans", "SELECT urn FROM v_snapshot_old WHERE urn NOT IN (SELECT urn FROM v_snapshot_new)")
def j5_orphans(c: Catalog):
    return c.view("v_snapshot_old").join(c.view("v_snapshot_new"), "urn", "left_anti").select("urn")


@query("j7_resolve_columns", """
    WITH names AS (SELECT DISTINCT concat(upper(c.name), '.', k.name) AS qualified_name FROM v_columns k JOIN v_capsules c ON c.urn = k.capsule_urn
      UNION ALL SELECT concat(c.schema_name, '.', c.name, '.', k.name) FROM v_columns k JOIN v_capsules c ON c.urn = k.capsule_urn)
    SELECT n.qualified_name, k.urn AS column_urn FROM names n JOIN v_capsules c ON lower(c.name) = lower(split_part(n.qualified_name, '.', -2))
      AND (len(string_split(n.qualified_name, '.')) = 2 OR lower(c.schema_name) = lower(split_part(n.qualified_name, '.', 1)))
    JOIN v_columns k ON k.capsule_urn = c.urn AND k.name = split_part(n.qualified_name, '.', -1)""")
def j7_resolve_columns(c: Catalog):
    capsules, columns = c.view("v_capsules"), c.view("v_columns")
    pairs = columns.select("capsule_urn", F.col("name").alias("k")).join(capsules.select(F.col("urn").alias("capsule_urn"), "name", "schema_name"), "capsule_urn")
    short = pairs.select(F.concat_ws(".", F.upper("name"), "k").alias("qualified_name")).distinct()
    names = short.unionByName(pairs.select(F.concat_ws(".", "schema_name", "name", "k").alias("qualified_name")))
    return rollups.resolve_columns(names, capsules, columns)


@query("j11_footprint", "SELECT pipeline_urn, edge_type, count(DISTINCT capsule_urn) AS capsules, count(*) AS edges FROM v_task_edges GROUP BY 1, 2")
def j11_footprint(c: Catalog):
    return rollups.footprint(c.view("v_task_edges"))


@query("j12_violations_with_rules", "SELECT id, rule_id, severity, status, category, rule_set FROM v_violations JOIN v_rules USING (rule_id)")
def j12_violations_with_rules(c: Catalog):
    return rollups.with_rules(c.view("v_violations"), c.view("v_rules")).select("id", "rule_id", "severity", "status", "category", "rule_set")


@query("j13_workflow_sources", """
    SELECT source_system, pipeline_type, nations, count(*) AS n FROM v_workflows JOIN (SELECT concat('system_', CAST(n_nationkey % 3 AS STRING)) AS source_system, count(*) AS nations FROM nation GROUP BY 1) USING (source_system) GROUP BY 1, 2, 3""")
def j13_workflow_sources(c: Catalog):
    name = F.concat(F.lit("system_"), (F.col("n_nationkey") % 3).cast("string"))
    systems = c.table("nation").groupBy(name.alias("source_system")).agg(F.count("*").alias("nations"))
    counted = c.view("v_workflows").groupBy("source_system", "pipeline_type").agg(F.count("*").alias("n"))
    return counted.join(systems, "source_system").select("source_system", "pipeline_type", "nations", "n")


# ---------------------------------------------------- windows, order, sets


@query("w1_latest_profile", """
    SELECT column_urn, capsule_urn, profiled_at, completeness_score, validity_score, uniqueness_score, null_percentage, unique_percentage
    FROM v_profile_runs QUALIFY row_number() OVER (PARTITION BY column_urn ORDER BY profiled_at DESC) = 1""")
def w1_latest_profile(c: Catalog):
    return rollups.latest_per_key(c.view("v_profile_runs"), ["column_urn"], "profiled_at")


@query("w1_current_version", "SELECT capsule_urn, version_number, change_type, breaking_change FROM v_versions QUALIFY row_number() OVER (PARTITION BY capsule_urn ORDER BY version_number DESC) = 1")
def w1_current_version(c: Catalog):
    return rollups.latest_per_key(c.view("v_versions").select("capsule_urn", "version_number", "change_type", "breaking_change"), ["capsule_urn"], "version_number")


@query("tk1_page", "SELECT urn, name FROM v_capsules ORDER BY name, urn LIMIT 100 OFFSET 50")
def tk1_page(c: Catalog):
    return filters.page(c.view("v_capsules").select("urn", "name"), ["name", "urn"], 50, 100)


@query("tk3_urgent_alerts", """
    SELECT id, severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS rank FROM v_alerts WHERE NOT resolved ORDER BY rank, created_at DESC, id""")
def tk3_urgent_alerts(c: Catalog):
    return rollups.alerts_by_urgency(c.view("v_alerts")).select("id", "severity", "rank")


@query("tk6_catalog_by_name", "SELECT name, urn, layer FROM v_capsules ORDER BY name, urn")
def tk6_catalog_by_name(c: Catalog):
    return c.view("v_capsules").select("name", "urn", "layer").orderBy("name", "urn")


@query("set1_union_edges", "SELECT source_urn, target_urn FROM v_edges UNION ALL SELECT source_urn, target_urn FROM v_capsule_edges")
def set1_union_edges(c: Catalog):
    return c.view("v_edges").unionByName(c.view("v_capsule_edges").select("source_urn", "target_urn"))


@query("set2_first_wins", """
    SELECT urn, arg_min(kind, priority) AS kind FROM (SELECT urn, 'capsule' AS kind, 1 AS priority FROM v_capsules
      UNION ALL SELECT capsule_urn, 'policy', 2 FROM v_policies UNION ALL SELECT capsule_urn, 'incident', 3 FROM v_incidents) GROUP BY urn""")
def set2_first_wins(c: Catalog):
    rows = (
        c.view("v_capsules").select("urn", F.lit("capsule").alias("kind"), F.lit(1).alias("priority"))
        .unionByName(c.view("v_policies").select(F.col("capsule_urn").alias("urn"), F.lit("policy").alias("kind"), F.lit(2).alias("priority")))
        .unionByName(c.view("v_incidents").select(F.col("capsule_urn").alias("urn"), F.lit("incident").alias("kind"), F.lit(3).alias("priority")))
    )
    return rows.groupBy("urn").agg(F.min_by("kind", "priority").alias("kind"))


@query("set4_except", "SELECT urn FROM v_snapshot_new EXCEPT SELECT urn FROM v_snapshot_old")
def set4_except(c: Catalog):
    return c.view("v_snapshot_new").join(c.view("v_snapshot_old"), "urn", "left_anti").select("urn")


@query("set5_distinct_values", "SELECT DISTINCT 'tag' AS kind, category FROM v_tags UNION ALL SELECT DISTINCT 'term', category FROM v_terms")
def set5_distinct_values(c: Catalog):
    return c.view("v_tags").select(F.lit("tag").alias("kind"), "category").distinct().unionByName(c.view("v_terms").select(F.lit("term").alias("kind"), "category").distinct())
