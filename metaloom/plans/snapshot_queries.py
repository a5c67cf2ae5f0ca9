"""Upsert, orphan, delta and status queries over two snapshots."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.plans.registry import Catalog, query
from metaloom.plans.views import NOW
from metaloom.sinks import upsert as up
from metaloom.sinks.buckets import BucketStore, refresh_view
from metaloom.sources import warehouse

_DELTA = """CASE WHEN o.urn IS NULL THEN 'created' WHEN n.urn IS NULL THEN 'missing' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'updated' END"""
_MERGED = f"""merged AS (SELECT coalesce(n.urn, o.urn) AS urn, CASE WHEN n.urn IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(o.updated, n.updated) AS updated, {_DELTA} AS _change
    FROM v_snapshot_old o FULL OUTER JOIN v_snapshot_new n ON o.urn = n.urn)"""


def merged(c: Catalog):
    return up.upsert(c.view("v_snapshot_old"), c.view("v_snapshot_new"), ["urn"], keep=["updated"])


@query("snk1_upsert", f"WITH {_MERGED} SELECT * FROM merged")
def snk1_upsert(c: Catalog):
    return merged(c)


_EDGE_OLD = "SELECT source_urn, target_urn, edge_type FROM v_capsule_edges"
_EDGE_NEW = "SELECT source_urn, target_urn, CASE WHEN edge_type = 'references' THEN 'joins' ELSE edge_type END AS edge_type FROM v_capsule_edges WHERE source_urn <> 'urn:cat:part:1' UNION ALL SELECT target_urn, source_urn, 'flows_to' FROM v_capsule_edges WHERE source_urn = 'urn:cat:part:2' AND target_urn NOT IN (SELECT source_urn FROM v_capsule_edges)"


@query("snk2_upsert_edges", f"""
    SELECT coalesce(n.source_urn, o.source_urn) AS source_urn, coalesce(n.target_urn, o.target_urn) AS target_urn, coalesce(n.edge_type, o.edge_type) AS edge_type,
      CASE WHEN o.source_urn IS NULL THEN 'created' WHEN n.source_urn IS NULL THEN 'missing' WHEN o.edge_type = n.edge_type THEN 'unchanged' ELSE 'updated' END AS _change
    FROM ({_EDGE_OLD}) o FULL OUTER JOIN ({_EDGE_NEW}) n ON o.source_urn = n.source_urn AND o.target_urn = n.target_urn""")
def snk2_upsert_edges(c: Catalog):
    edges = c.view("v_capsule_edges").select("source_urn", "target_urn", "edge_type")
    kept = edges.filter("source_urn <> 'urn:cat:part:1'").withColumn("edge_type", F.when(F.col("edge_type") == "references", "joins").otherwise(F.col("edge_type")))
    sources = edges.select(F.col("source_urn").alias("target_urn")).distinct()
    back = edges.filter("source_urn = 'urn:cat:part:2'").join(sources, "target_urn", "left_anti")
    fresh = back.select(F.col("target_urn").alias("source_urn"), F.lit("urn:cat:part:2").alias("target_urn"), F.lit("flows_to").alias("edge_type"))
    return up.upsert(edges, kept.unionByName(fresh), ["source_urn", "target_urn"])


@query("snk4_upsert_dependencies", """
    SELECT dag_id, task_id, capsule_urn, CASE WHEN is_active THEN 'read' ELSE dependency_type END AS dependency_type,
      CASE WHEN NOT is_active THEN 'missing' WHEN dependency_type = 'read' THEN 'unchanged' ELSE 'updated' END AS _change FROM v_task_dependencies""")
def snk4_upsert_dependencies(c: Catalog):
    rows = c.view("v_task_dependencies")
    stored = rows.select("dag_id", "task_id", "capsule_urn", "dependency_type")
    incoming = rows.filter("is_active").select("dag_id", "task_id", "capsule_urn", F.lit("read").alias("dependency_type"))
    return up.upsert(stored, up.one_per_key(incoming, ["dag_id", "task_id", "capsule_urn"]), ["dag_id", "task_id", "capsule_urn"])


_VIOLATIONS = "SELECT id, rule_id, CAST(subject AS STRING) AS capsule_urn, CAST(NULL AS STRING) AS column_urn, severity, status, detected_at, ingestion_id FROM v_violations"


def _violations(c: Catalog):
    return c.view("v_violations").select("id", "rule_id", F.col("subject").cast("string").alias("capsule_urn"), F.lit(None).cast("string").alias("column_urn"), "severity", "status", "detected_at",
                                         "ingestion_id", F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"))


@query("snk6_upsert_violations", f"""
    WITH s AS ({_VIOLATIONS}), o AS (SELECT rule_id, capsule_urn, max(severity) AS severity FROM s WHERE status = 'open' GROUP BY 1, 2),
    f AS (SELECT rule_id, capsule_urn, max(severity) AS severity FROM s WHERE ingestion_id = 'ingest_1' OR status = 'resolved' GROUP BY 1, 2)
    SELECT coalesce(f.rule_id, o.rule_id) AS rule_id, coalesce(f.capsule_urn, o.capsule_urn) AS capsule_urn, coalesce(f.severity, o.severity) AS severity, f.rule_id IS NOT NULL AS refreshed,
      CASE WHEN o.rule_id IS NULL THEN 'created' WHEN f.rule_id IS NULL THEN 'missing' ELSE 'updated' END AS _change
    FROM o FULL OUTER JOIN f ON o.rule_id = f.rule_id AND o.capsule_urn = f.capsule_urn""")
def snk6_upsert_violations(c: Catalog):
    rows = _violations(c)
    keys = ["rule_id", "capsule_urn", "column_urn"]
    stored = rows.filter("status = 'open'").groupBy(*keys).agg(
        F.max("severity").alias("severity"), F.first("status").alias("status"), F.max("detected_at").alias("detected_at"), F.lit("old").alias("ingestion_id"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"))
    found = rows.filter("ingestion_id = 'ingest_1' or status = 'resolved'").groupBy(*keys).agg(F.max("severity").alias("severity"), F.lit("new").alias("ingestion_id"))
    now = "2030-01-01 00:00:00"
    out = up.upsert_violations(stored, found, now)
    return out.select("rule_id", "capsule_urn", "severity", (F.col("detected_at") == F.lit(now).cast("timestamp_ntz")).alias("refreshed"), "_change")


@query("snk7_auto_resolve", f"""
    SELECT id, CASE WHEN s THEN 'resolved' ELSE status END AS status, CASE WHEN s THEN 'auto_resolved' END AS resolved_by FROM (
      SELECT *, status = 'open' AND ingestion_id <> 'ingest_2' AND severity <> 'critical' AS s FROM ({_VIOLATIONS}))""")
def snk7_auto_resolve(c: Catalog):
    rows = _violations(c)
    return up.auto_resolve(rows, rows.filter("severity = 'critical'"), "ingest_2", NOW).select("id", "status", "resolved_by")


@query("snk8_set_status", f"SELECT id, CASE WHEN severity = 'info' THEN 'false_positive' ELSE status END AS status, CASE WHEN severity = 'info' THEN 'steward' END AS resolved_by FROM ({_VIOLATIONS})")
def snk8_set_status(c: Catalog):
    rows = _violations(c)
    return up.set_status(rows, rows.filter("severity = 'info'"), "false_positive", NOW, "steward").select("id", "status", "resolved_by")


_GONE = "gone AS (SELECT urn FROM v_capsules WHERE source_system = 'system_1' AND capsule_type = 'model')"


@query("snk9_orphans", f"""
    WITH {_GONE} SELECT 'capsule' AS entity, urn AS key FROM gone UNION ALL SELECT 'column', urn FROM v_columns WHERE capsule_urn IN (SELECT urn FROM gone)
    UNION ALL SELECT 'edge', concat(source_urn, '>', target_urn) FROM v_capsule_edges WHERE source_urn IN (SELECT urn FROM gone) OR target_urn IN (SELECT urn FROM gone)""")
def snk9_orphans(c: Catalog):
    stored = c.view("v_capsules")
    gone = up.orphans(stored, stored.filter("capsule_type <> 'model'"), ["urn"], "system_1")
    columns, edges = up.cascade(gone, c.view("v_columns"), c.view("v_capsule_edges"))
    return (
        gone.select(F.lit("capsule").alias("entity"), F.col("urn").alias("key")).unionByName(columns.select(F.lit("column").alias("entity"), F.col("urn").alias("key")))
        .unionByName(edges.select(F.lit("edge").alias("entity"), F.concat_ws(">", "source_urn", "target_urn").alias("key")))
    )


_COUNTS = "count(*) FILTER (_change = 'created') AS created, count(*) FILTER (_change = 'updated') AS updated, count(*) FILTER (_change = 'unchanged') AS unchanged, count(*) FILTER (_change = 'missing') AS deleted"


@query("snk10_delta_counts", f"""
    WITH {_MERGED}, col AS (SELECT CASE WHEN o.urn IS NULL THEN 'created' WHEN n.urn IS NULL THEN 'missing' WHEN o.data_type = n.data_type THEN 'unchanged' ELSE 'updated' END AS _change
      FROM v_schema_old o FULL OUTER JOIN v_schema_new n ON o.urn = n.urn), alls AS (SELECT 'rows' AS entity, _change FROM merged UNION ALL SELECT 'columns', _change FROM col)
    SELECT entity, {_COUNTS} FROM alls GROUP BY 1 UNION ALL SELECT 'total', {_COUNTS} FROM alls""")
def snk10_delta_counts(c: Catalog):
    columns = up.upsert(c.view("v_schema_old"), c.view("v_schema_new"), ["urn"])
    dropped = lambda df: df.withColumn("_change", F.when(F.col("_change") == up.MISSING, up.DELETED).otherwise(F.col("_change")))
    return up.delta_counts({"rows": dropped(merged(c)), "columns": dropped(columns)})


@query("snk11_delete_ingestion", "SELECT id, ingestion_id FROM v_violations WHERE ingestion_id <> 'ingest_3'")
def snk11_delete_ingestion(c: Catalog):
    return up.without_ingestion(c.view("v_violations"), "ingest_3").select("id", "ingestion_id")


@query("snk12_get_or_create", "SELECT p_brand AS name, 'known' AS origin FROM part WHERE p_type = 'PROMO' GROUP BY 1 UNION ALL SELECT DISTINCT n, NULL FROM (SELECT concat('Brand#', CAST(p_size AS STRING)) AS n FROM part) WHERE n NOT IN (SELECT p_brand FROM part WHERE p_type = 'PROMO')")
def snk12_get_or_create(c: Catalog):
    part = c.table("part")
    stored = part.filter("p_type = 'PROMO'").select(F.col("p_brand").alias("name"), F.lit("known").alias("origin")).distinct()
    return up.get_or_create(stored, part.select(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("name")))


@query("src13_incremental", f"SELECT database_name, schema_name, table_name FROM v_wh_tables WHERE last_altered > TIMESTAMP '2001-06-01 00:00:00' AND schema_name NOT IN ('INFORMATION_SCHEMA', 'ACCOUNT_USAGE')")
def src13_incremental(c: Catalog):
    from metaloom.sources import warehouse

    return warehouse.tables(c.view("v_wh_tables"), since="2001-06-01 00:00:00").select("database_name", "schema_name", "table_name")


# ------------------------------------------------- bucket stores


def _store(c: Catalog, schema, keys, name: str, buckets: int = 16):
    return BucketStore(c.spark, staging.new_stage(c.spark, name), schema, keys, buckets)


@query("snk1_bucketed", f"WITH {_MERGED.replace('coalesce(o.updated, n.updated)', 'CASE WHEN n.urn IS NOT NULL THEN n.updated ELSE o.updated END')} SELECT urn, v, updated FROM merged")
def snk1_bucketed(c: Catalog):
    old, new = c.view("v_snapshot_old"), c.view("v_snapshot_new")
    store = _store(c, old.schema, ["urn"], "bucketed")
    store.merge(old, 1)
    store.merge(new, 2)
    return store.read()


@query("src13_bucketed_sync", f"""
    WITH s AS (SELECT database_name, schema_name, table_name, table_type, last_altered FROM v_wh_tables WHERE schema_name NOT IN ('INFORMATION_SCHEMA', 'ACCOUNT_USAGE'))
    SELECT database_name, schema_name, table_name, CASE WHEN last_altered > TIMESTAMP '2001-06-01 00:00:00' THEN 'ALTERED' ELSE table_type END AS table_type, last_altered FROM s""")
def src13_bucketed_sync(c: Catalog):
    """A full sync, then one of the tables altered since its mark, which go into their buckets alone."""
    keys = ["database_name", "schema_name", "table_name"]
    columns = [*keys, "table_type", "last_altered"]
    full = warehouse.tables(c.view("v_wh_tables")).select(*columns)
    store = _store(c, full.schema, keys, "synced")
    store.merge(full, 1)
    recent = warehouse.tables(c.view("v_wh_tables"), since="2001-06-01 00:00:00").select(*columns).withColumn("table_type", F.lit("ALTERED"))
    store.merge(recent, 2)
    store.compact(3)
    return store.read()


@query("src13_sync_counts", f"""
    WITH s AS (SELECT last_altered > TIMESTAMP '2001-06-01 00:00:00' AS recent FROM v_wh_tables WHERE schema_name NOT IN ('INFORMATION_SCHEMA', 'ACCOUNT_USAGE'))
    SELECT 1 AS version, 'rows' AS entity, count(*) AS created, 0 AS updated FROM s UNION ALL SELECT 2, 'rows', 0, count(*) FROM s WHERE recent""")
def src13_sync_counts(c: Catalog):
    keys = ["database_name", "schema_name", "table_name"]
    full = warehouse.tables(c.view("v_wh_tables")).select(*keys, "table_type")
    store = _store(c, full.schema, keys, "counted")
    store.merge(full, 1)
    store.merge(warehouse.tables(c.view("v_wh_tables"), since="2001-06-01 00:00:00").select(*keys, F.lit("ALTERED").alias("table_type")), 2)
    return store.changes().where("entity = 'rows'").select("version", "entity", "created", "updated")


@query("snk23_refresh_view", """
    SELECT capsule_urn, count(*) AS columns, count(*) FILTER (data_type = 'VARCHAR') AS texts, 'now' AS part FROM v_schema_new GROUP BY 1
    UNION ALL SELECT coalesce(n.capsule_urn, o.capsule_urn), coalesce(n.columns, o.columns), coalesce(n.texts, o.texts), CASE WHEN o.capsule_urn IS NULL THEN 'created' WHEN n.capsule_urn IS NULL THEN 'missing' ELSE 'updated' END
    FROM (SELECT capsule_urn, count(*) AS columns, count(*) FILTER (data_type = 'VARCHAR') AS texts FROM v_schema_old GROUP BY 1) o FULL OUTER JOIN (SELECT capsule_urn, count(*) AS columns, count(*) FILTER (data_type = 'VARCHAR') AS texts FROM v_schema_new GROUP BY 1) n
      ON o.capsule_urn = n.capsule_urn WHERE o.capsule_urn IS NULL OR n.capsule_urn IS NULL OR o.columns <> n.columns OR o.texts <> n.texts""")
def snk23_refresh_view(c: Catalog):
    summary = lambda v: c.view(v).groupBy("capsule_urn").agg(F.count("*").alias("columns"), F.count_if(F.col("data_type") == "VARCHAR").alias("texts"))
    folder = staging.new_stage(c.spark, "refreshed")
    refresh_view(c.spark, summary("v_schema_old"), folder, ["capsule_urn"], 16)
    now, changed = refresh_view(c.spark, summary("v_schema_new"), folder, ["capsule_urn"], 16)
    return now.withColumn("part", F.lit("now")).unionByName(changed.withColumnRenamed("_change", "part"))


# ------------------------------------------- orchestration tables and rules


def _runs(c: Catalog):
    """Orchestration tables as stored and as the next run brings them."""
    flows = c.view("v_workflows").select("urn", "name", "schedule_interval")
    tasks = c.view("v_tasks")
    edges = c.view("v_task_order").select(F.col("source_task_urn").alias("source_urn"), F.col("target_task_urn").alias("target_urn"), F.lit("depends_on").alias("edge_type"))
    data = c.view("v_task_edges").select("task_urn", "capsule_urn", "edge_type", "criticality_score")
    mapped = c.view("v_task_column_edges").select("task_urn", F.col("column_urn").alias("source_column_urn"), F.concat("column_urn", F.lit("_out")).alias("target_column_urn"), F.col("edge_type").alias("transformation_type"))
    stored = {
        "workflows": flows.where("schedule_interval <> '@once'"), "tasks": tasks.where("name <> 'task_1'"), "task_edges": edges.where("source_urn not like '%.2'"),
        "data_edges": data, "column_mappings": mapped.where("transformation_type = 'reads'"),
    }
    hourly = F.when(F.col("schedule_interval") == "@hourly", "@daily").otherwise(F.col("schedule_interval"))
    incoming = {
        "workflows": flows.withColumn("schedule_interval", hourly), "tasks": tasks, "task_edges": edges.where("source_urn not like '%.3'"),
        "data_edges": data.where("edge_type <> 'validates'").withColumn("criticality_score", F.lit(0.5)), "column_mappings": mapped.withColumn("transformation_type", F.upper("transformation_type")),
    }
    return stored, incoming


_RUN_SQL = """m AS (SELECT task_urn, column_urn, edge_type FROM v_task_column_edges), o AS (SELECT source_task_urn AS s, target_task_urn AS t FROM v_task_order),
    changed AS (
      SELECT 'workflows' AS entity, urn AS key, CASE schedule_interval WHEN '@once' THEN 'created' WHEN '@hourly' THEN 'updated' ELSE 'unchanged' END AS _change FROM v_workflows
      UNION ALL SELECT 'tasks', task_urn, CASE WHEN name = 'task_1' THEN 'created' ELSE 'unchanged' END FROM v_tasks
      UNION ALL SELECT 'task_edges', concat(s, '>', t), CASE WHEN s LIKE '%.2' THEN 'created' WHEN s LIKE '%.3' THEN 'missing' ELSE 'unchanged' END FROM o
      UNION ALL SELECT 'data_edges', concat(task_urn, '>', capsule_urn, '>', edge_type), CASE WHEN edge_type = 'validates' THEN 'missing' WHEN criticality_score = 0.5 THEN 'unchanged' ELSE 'updated' END FROM v_task_edges
      UNION ALL SELECT 'column_mappings', concat(task_urn, '>', column_urn), CASE WHEN max(edge_type) = min(edge_type) AND min(edge_type) = 'writes' THEN 'created' ELSE 'updated' END FROM m GROUP BY task_urn, column_urn)"""


@query("snk3_upsert_orchestration", f"WITH {_RUN_SQL} SELECT entity, key, _change FROM changed")
def snk3_upsert_orchestration(c: Catalog):
    stored, incoming = _runs(c)
    key = {"workflows": F.col("urn"), "tasks": F.col("task_urn"), "task_edges": F.concat_ws(">", "source_urn", "target_urn"), "data_edges": F.concat_ws(">", "task_urn", "capsule_urn", "edge_type"), "column_mappings": F.concat_ws(">", "task_urn", "source_column_urn")}
    parts = [df.select(F.lit(name).alias("entity"), key[name].alias("key"), "_change") for name, df in up.upsert_orchestration(stored, incoming).items()]
    return reduce(DataFrame.unionByName, parts)


@query("snk3_delta_counts", f"WITH {_RUN_SQL} SELECT entity, {_COUNTS.replace('deleted', 'missing')} FROM changed GROUP BY 1")
def snk3_delta_counts(c: Catalog):
    stored, incoming = _runs(c)
    marked = {name: df.withColumn("_change", F.when(F.col("_change") == up.MISSING, up.DELETED).otherwise(F.col("_change"))) for name, df in up.upsert_orchestration(stored, incoming).items()}
    return up.delta_counts(marked).where("entity <> 'total'").withColumnRenamed("deleted", "missing")


_RULES_OLD = "SELECT rule_id, category, enabled FROM v_rules WHERE rule_set = 'set_a' OR scope = 'column'"
_RULES_NEW = "SELECT rule_id, CASE WHEN category = 'pii' THEN 'privacy' ELSE category END AS category, enabled FROM v_rules WHERE scope <> 'column'"
_RULE_CHANGES = f"""r AS (SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.category, o.category) AS category, coalesce(n.enabled, o.enabled) AS enabled,
      CASE WHEN o.rule_id IS NULL THEN 'created' WHEN n.rule_id IS NULL THEN 'missing' WHEN o.category = n.category AND o.enabled = n.enabled THEN 'unchanged' ELSE 'updated' END AS _change
      FROM ({_RULES_OLD}) o FULL OUTER JOIN ({_RULES_NEW}) n ON o.rule_id = n.rule_id)"""


def _rule_sync(c: Catalog):
    rules = c.view("v_rules").select("rule_id", "category", "enabled", "rule_set", "scope")
    declared = rules.where("scope <> 'column'").withColumn("category", F.when(F.col("category") == "pii", "privacy").otherwise(F.col("category")))
    return up.upsert_rules(rules.where("rule_set = 'set_a' OR scope = 'column'").select("rule_id", "category", "enabled"), declared.select("rule_id", "category", "enabled"))


@query("snk5_upsert_rules", f"WITH {_RULE_CHANGES} SELECT * FROM r")
def snk5_upsert_rules(c: Catalog):
    return _rule_sync(c)[0]


@query("snk5_sync_counts", f"WITH {_RULE_CHANGES} SELECT count(*) FILTER (_change = 'created') AS created, count(*) FILTER (_change = 'updated') AS updated, count(*) FILTER (_change <> 'missing') AS total FROM r")
def snk5_sync_counts(c: Catalog):
    return _rule_sync(c)[1]
