"""Schedule, timeline, change-impact and service-objective queries."""

from pyspark.sql import functions as F

from metaloom import staging
from metaloom.functions import classify, schedule
from metaloom.operators import impact, rollups, slo, timeline
from metaloom.plans.registry import Catalog, query
from metaloom.plans.views import NOW
from metaloom.sources import orchestrator

# ------------------------------------------------------- oracle fragments

CRON = """CASE schedule_interval WHEN '@hourly' THEN '0 * * * *' WHEN '@daily' THEN '0 0 * * *' WHEN '@weekly' THEN '0 0 * * 0' WHEN '@monthly' THEN '0 0 1 * *'
  WHEN '@yearly' THEN '0 0 1 1 *' WHEN '@once' THEN NULL WHEN 'None' THEN NULL ELSE schedule_interval END"""
_MIN, _HOUR = "split_part(cron, ' ', 1)", "split_part(cron, ' ', 2)"
RUNS = f"""CASE WHEN cron IS NULL THEN NULL WHEN {_MIN} = '*' AND {_HOUR} = '*' THEN 1440.0 WHEN {_HOUR} = '*' THEN 24.0
  WHEN {_MIN} <> '*' THEN CAST(len(string_split({_MIN}, ',')) * len(string_split({_HOUR}, ',')) AS DOUBLE) ELSE 1.0 END"""
HOURS = f"""CASE WHEN {_HOUR} = '*' THEN range(0, 24) WHEN {_HOUR} LIKE '%/%' THEN range(0, 24, CAST(split_part({_HOUR}, '/', 2) AS BIGINT))
  ELSE CAST(string_split({_HOUR}, ',') AS BIGINT[]) END"""
FREQUENCY = """CASE WHEN contains(schedule_interval, '@hourly') OR contains(schedule_interval, '0 * * * *') THEN 10.0 WHEN contains(schedule_interval, '@daily') OR contains(schedule_interval, '0 0 * * *') THEN 8.0
  WHEN contains(schedule_interval, '@weekly') OR contains(schedule_interval, '0 0 * * 0') THEN 4.0 WHEN contains(schedule_interval, '@monthly') OR contains(schedule_interval, '0 0 1 * *') THEN 2.0
  ELSE least(10.0, 2.0 * (length(schedule_interval) - length(replace(schedule_interval, '*', '')))) END"""
_SCHED = f"s0 AS (SELECT *, {CRON} AS cron FROM v_workflows), sched AS (SELECT *, CAST({RUNS} AS DOUBLE) AS runs, {HOURS} AS hours FROM s0 WHERE cron IS NOT NULL), hc AS (SELECT source_system, hour, count(*) AS tasks FROM (SELECT source_system, unnest(hours) AS hour FROM sched) GROUP BY 1, 2)"
GROUP = "source_system"


def scheduled(c: Catalog):
    return timeline.schedules(c.view("v_workflows"))


@query("f13_f15_schedules", f"""
    WITH s0 AS (SELECT *, {CRON} AS cron FROM v_workflows)
    SELECT urn, cron, CAST({RUNS} AS DOUBLE) AS runs_per_day, CASE WHEN cron IS NULL THEN '' ELSE array_to_string({HOURS}, ',') END AS hours FROM s0""")
def f13_f15_schedules(c: Catalog):
    cron = schedule.cron_of(F.col("schedule_interval"))
    rows = c.view("v_workflows").withColumn("cron", cron)
    hours = F.array_join(F.transform(schedule.hours_of(F.col("cron")), lambda h: h.cast("string")), ",")
    return rows.select("urn", "cron", schedule.runs_per_day(F.col("cron")).alias("runs_per_day"), hours.alias("hours"))


@query("f19_frequency_score", f"SELECT urn, {FREQUENCY} AS score FROM v_workflows")
def f19_frequency_score(c: Catalog):
    return c.view("v_workflows").select("urn", schedule.frequency_score(F.col("schedule_interval")).alias("score"))


@query("f25_periods", "SELECT event_id, CASE WHEN h BETWEEN 6 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 17 THEN 'afternoon' WHEN h BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS period FROM (SELECT event_id, hour(ts) AS h FROM events)")
def f25_periods(c: Catalog):
    return c.table("events").select("event_id", schedule.period_of(F.hour("ts")).alias("period"))


@query("f16_f17_task_types", """
    WITH t AS (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'PythonOperator' WHEN 'click' THEN 'SnowflakeOperator' WHEN 'error' THEN 'BashSensor' WHEN 'signup' THEN 'DbtRunOperator' ELSE 'TriggerDagRun' END AS operator,
      concat(CASE user_id % 5 WHEN 0 THEN 'extract_' WHEN 1 THEN 'insert_' WHEN 2 THEN 'quality_' WHEN 3 THEN 'merge_' ELSE 'where_' END, CAST(user_id AS STRING)) AS task_id FROM events)
    SELECT operator, task_id, CASE operator WHEN 'PythonOperator' THEN 'python' WHEN 'SnowflakeOperator' THEN 'sql' WHEN 'BashSensor' THEN 'bash' WHEN 'DbtRunOperator' THEN 'dbt' ELSE 'trigger' END AS task_type,
      CASE WHEN task_id LIKE 'extract%' THEN 'extract' WHEN task_id LIKE 'insert%' THEN 'load' WHEN operator = 'DbtRunOperator' THEN 'transform' WHEN task_id LIKE 'quality%' THEN 'validate'
        WHEN task_id LIKE 'merge%' THEN 'join' ELSE 'filter' END AS operation_type FROM t""")
def f16_f17_task_types(c: Catalog):
    kind, n = F.col("event_type"), F.col("user_id") % 5
    operator = F.when(kind == "view", "PythonOperator").when(kind == "click", "SnowflakeOperator").when(kind == "error", "BashSensor").when(kind == "signup", "DbtRunOperator").otherwise("TriggerDagRun")
    verb = F.when(n == 0, "extract_").when(n == 1, "insert_").when(n == 2, "quality_").when(n == 3, "merge_").otherwise("where_")
    tasks = c.table("events").select(operator.alias("operator"), F.concat(verb, F.col("user_id").cast("string")).alias("task_id")).distinct()
    return tasks.select("operator", "task_id", classify.task_type(F.col("operator")).alias("task_type"), classify.operation_type(F.col("operator"), F.col("task_id")).alias("operation_type"))


@query("f18_dependency_types", """
    SELECT edge_type, CASE edge_type WHEN 'produces' THEN 'write' WHEN 'transforms' THEN 'transform' ELSE 'read' END AS dependency_type, count(*) AS n FROM v_task_edges GROUP BY 1, 2""")
def f18_dependency_types(c: Catalog):
    return c.view("v_task_edges").groupBy("edge_type").agg(F.count("*").alias("n")).select("edge_type", classify.dependency_type(F.col("edge_type")).alias("dependency_type"), "n")


@query("src22_malformed_urns", """
    WITH a AS (SELECT task_urn, CASE WHEN edge_type = 'validates' THEN replace(capsule_urn, ':', '/') WHEN edge_type = 'produces' THEN 'urn:cat:part:' ELSE capsule_urn END AS capsule_urn FROM v_task_edges)
    SELECT task_urn, capsule_urn FROM a WHERE NOT regexp_matches(capsule_urn, '^urn:cat:[^:]+:.+')""")
def src22_malformed_urns(c: Catalog):
    edge, urn = F.col("edge_type"), F.col("capsule_urn")
    broken = F.when(edge == "validates", F.replace(urn, F.lit(":"), F.lit("/"))).when(edge == "produces", "urn:cat:part:").otherwise(urn)
    return orchestrator.malformed_urns(c.view("v_task_edges").select("task_urn", broken.alias("capsule_urn")))


@query("src23_best_statement", """
    WITH m AS (SELECT task_urn, CASE edge_type WHEN 'consumes' THEN 'select' WHEN 'produces' THEN 'insert' ELSE 'update' END AS statement, capsule_urn FROM v_task_edges)
    SELECT task_urn, statement, capsule_urn FROM m QUALIFY rank() OVER (PARTITION BY task_urn ORDER BY CASE statement WHEN 'select' THEN 1 WHEN 'insert' THEN 2 ELSE 3 END) = 1""")
def src23_best_statement(c: Catalog):
    statement = F.when(F.col("edge_type") == "consumes", "select").when(F.col("edge_type") == "produces", "insert").otherwise("update")
    return orchestrator.best_statement(c.view("v_task_edges").select("task_urn", statement.alias("statement"), "capsule_urn"))


@query("tmp1_frequency", f"""
    WITH {_SCHED} SELECT source_system, sum(runs) AS executions_per_day, sum(runs) * 7 AS executions_per_week,
      CASE WHEN sum(runs) >= 24 THEN 'hourly' WHEN sum(runs) >= 7 THEN 'several_a_day' WHEN sum(runs) >= 1 THEN 'daily'
        WHEN sum(runs) >= 0.5 THEN 'some_days' ELSE 'rare' END AS schedule_pattern FROM sched GROUP BY 1""")
def tmp1_frequency(c: Catalog):
    return timeline.frequency(scheduled(c), GROUP)


@query("tmp1_peak_hours", f"WITH {_SCHED} SELECT source_system, hour, tasks FROM (SELECT *, avg(tasks) OVER (PARTITION BY source_system) AS m FROM hc) WHERE tasks >= m")
def tmp1_peak_hours(c: Catalog):
    return timeline.peak_hours(scheduled(c), GROUP)


# grouped by workflow, so that gaps exist
_ONE = f"s0 AS (SELECT *, {CRON} AS cron FROM v_workflows), sched AS (SELECT urn, {HOURS} AS hours FROM s0 WHERE cron IS NOT NULL), hc AS (SELECT urn, hour, count(*) AS tasks FROM (SELECT urn, unnest(hours) AS hour FROM sched) GROUP BY 1, 2)"
_QUIET = f"""{_ONE}, idle AS (SELECT urn, h AS hour FROM sched, range(0, 24) t(h) WHERE NOT list_contains(hours, h)),
    runs AS (SELECT urn, min(hour) AS start_hour, max(hour) + 1 AS end_hour FROM (SELECT *, hour - row_number() OVER (PARTITION BY urn ORDER BY hour) AS g FROM idle) GROUP BY urn, g),
    quiet AS (SELECT urn, start_hour, end_hour, row_number() OVER (PARTITION BY urn ORDER BY start_hour) AS rank, CAST(0.1 AS DOUBLE) AS impact_score, 'idle' AS reason, end_hour - start_hour AS idle_hours
      FROM runs WHERE end_hour - start_hour >= 4)"""


@query("tmp2_quiet_windows", f"WITH {_QUIET} SELECT * FROM quiet WHERE rank <= 3")
def tmp2_quiet_windows(c: Catalog):
    return timeline.quiet_windows(scheduled(c), "urn")


@query("tmp7_best_window", f"WITH {_QUIET} SELECT * EXCLUDE (rank) FROM quiet WHERE rank = 1")
def tmp7_best_window(c: Catalog):
    return timeline.best_window(scheduled(c), "urn")


@query("tmp3_busy_windows", f"""
    WITH {_SCHED}, top AS (SELECT *, max(tasks) OVER (PARTITION BY source_system) AS m FROM hc), hot AS (SELECT * FROM top WHERE tasks >= m * 0.8),
    runs AS (SELECT source_system, min(hour) AS start_hour, max(hour) + 1 AS end_hour, max(m) AS m FROM (SELECT *, hour - row_number() OVER (PARTITION BY source_system ORDER BY hour) AS g FROM hot) GROUP BY source_system, g)
    SELECT source_system, start_hour, end_hour, rank, CAST(0.9 AS DOUBLE) AS impact_score, 'busy' AS reason, m AS most_tasks
    FROM (SELECT *, row_number() OVER (PARTITION BY source_system ORDER BY start_hour) AS rank FROM runs) WHERE rank <= 3""")
def tmp3_busy_windows(c: Catalog):
    return timeline.busy_windows(scheduled(c), GROUP)


@query("tmp4_downtime", """
    SELECT dag_id, round(sum(CASE WHEN avg_execution_duration_seconds > 0 THEN avg_execution_duration_seconds ELSE 300 END / 60 * (1 + CASE WHEN criticality_score <> 0 THEN criticality_score * 100 ELSE 50 END / 100)), 2) AS estimated_downtime_minutes
    FROM v_task_dependencies GROUP BY 1""")
def tmp4_downtime(c: Catalog):
    tasks = c.view("v_task_dependencies").withColumn("risk", F.col("criticality_score") * 100)
    return timeline.downtime(tasks, "dag_id", "avg_execution_duration_seconds", "risk")


@query("tmp5_periods", f"WITH {_SCHED} SELECT source_system, CASE WHEN hour BETWEEN 6 AND 11 THEN 'morning' WHEN hour BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS period, CAST(sum(tasks) AS BIGINT) AS runs FROM hc GROUP BY 1, 2")
def tmp5_periods(c: Catalog):
    return timeline.periods(scheduled(c), GROUP)


@query("tmp6_next_runs", f"""
    SELECT urn, CASE schedule_interval WHEN '@hourly' THEN TIMESTAMP '2001-09-01 11:00:00' WHEN '@daily' THEN TIMESTAMP '2001-09-02 00:00:00' WHEN '0 */6 * * *' THEN TIMESTAMP '2001-09-01 12:00:00'
      WHEN '30 2,14 * * *' THEN TIMESTAMP '2001-09-01 14:30:00' ELSE TIMESTAMP '2001-09-03 09:15:00' END AS next_execution FROM v_workflows WHERE schedule_interval <> '@once'""")
def tmp6_next_runs(c: Catalog):
    return timeline.next_runs(scheduled(c), "urn", "2001-09-01 10:20:00")


# ----------------------------------------------------------------- impact


def _risk_sql(change: str) -> str:
    score = f"""least(100.0, greatest(0.0, CASE dependency_type WHEN 'read' THEN 30 WHEN 'write' THEN 20 ELSE 25 END
      + CASE {change} WHEN 'delete' THEN 30 WHEN 'rename' THEN 20 WHEN 'type_change' THEN 25 WHEN 'nullability' THEN 15 WHEN 'default' THEN 10 ELSE 15 END
      + criticality_score * 20 + CASE WHEN success_rate <> 0 THEN (100 - success_rate) / 10 ELSE 0 END + {FREQUENCY}))"""
    return score


def _tasks_sql(view: str) -> str:
    return f"""tasks AS (SELECT e.task_urn, w.name AS dag_id, t.name AS task_id, e.capsule_urn, CASE e.edge_type WHEN 'produces' THEN 'write' WHEN 'transforms' THEN 'transform' ELSE 'read' END AS dependency_type,
      w.schedule_interval, e.criticality_score, e.success_rate FROM {view} e JOIN v_tasks t ON t.task_urn = e.task_urn JOIN v_workflows w ON w.urn = t.pipeline_urn)"""


_LEVEL = "CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'medium' ELSE 'low' END"


def tasks_of(c: Catalog, view: str):
    return rollups.tasks_of_capsules(c.view(view), c.view("v_tasks"), c.view("v_workflows"))


@query("imp1_task_risk", f"""
    WITH {_tasks_sql('v_task_edges')}, k(change_type) AS (VALUES ('delete'), ('rename'), ('comment')), r AS (SELECT *, {_risk_sql('change_type')} AS s FROM tasks, k)
    SELECT change_type, risk_level, count(*) AS tasks, round(sum(risk_score), 2) AS total_risk, max(risk_score) AS max_risk FROM (SELECT change_type, {_LEVEL} AS risk_level, round(s, 2) AS risk_score FROM r) GROUP BY 1, 2""")
def imp1_task_risk(c: Catalog):
    tasks = tasks_of(c, "v_task_edges").withColumn("change_type", F.explode(F.array(F.lit("delete"), F.lit("rename"), F.lit("comment"))))
    rows = impact.task_risk(tasks, F.col("change_type"))
    return rows.groupBy("change_type", "risk_level").agg(F.count("*").alias("tasks"), F.round(F.sum("risk_score"), 2).alias("total_risk"), F.max("risk_score").alias("max_risk"))


_COLUMNS = {"source": "source_column_urn", "target": "target_column_urn"}
_AFFECTED = f"""seeds AS (SELECT urn AS seed FROM v_column_nodes WHERE layer = 'bronze'),
    walk AS (SELECT source_column_urn AS seed, target_column_urn AS node, 1 AS depth FROM v_column_edges WHERE source_column_urn IN (SELECT seed FROM seeds)
      UNION SELECT w.seed, e.target_column_urn, w.depth + 1 FROM walk w JOIN v_column_edges e ON e.source_column_urn = w.node WHERE w.depth < 5),
    aff AS (SELECT a.seed, a.urn, n.capsule_urn FROM (SELECT DISTINCT seed, node AS urn FROM walk WHERE seed <> node UNION SELECT seed, seed FROM seeds) a JOIN v_column_nodes n ON n.urn = a.urn),
    {_tasks_sql('v_order_task_edges')}, hit AS (SELECT a.seed, t.*, {_risk_sql("'delete'")} AS s FROM (SELECT DISTINCT seed, capsule_urn FROM aff) a JOIN tasks t USING (capsule_urn)),
    risk AS (SELECT *, round(s, 2) AS risk_score, {_LEVEL} AS risk_level FROM hit)"""


def affected(c: Catalog):
    seeds = c.view("v_column_nodes").filter("layer = 'bronze'").select(F.col("urn").alias("seed"))
    return impact.affected_columns(c.view("v_column_edges"), c.view("v_column_nodes"), seeds, 5)


def hit_tasks(c: Catalog, found):
    return impact.affected_tasks(found, impact.task_risk(tasks_of(c, "v_order_task_edges"), F.lit("delete")))


@query("imp2_affected_tasks", f"WITH {_AFFECTED} SELECT seed, dag_id, task_id, count(*) AS edges, count(DISTINCT capsule_urn) AS capsules FROM risk GROUP BY 1, 2, 3")
def imp2_affected_tasks(c: Catalog):
    rows = hit_tasks(c, affected(c))
    return rows.groupBy("seed", "dag_id", "task_id").agg(F.count("*").alias("edges"), F.count_distinct("capsule_urn").alias("capsules"))


@query("imp3_per_workflow", f"""
    WITH {_AFFECTED} SELECT seed, dag_id, count(*) AS affected_task_count, count(*) FILTER (risk_level = 'critical') AS critical_task_count, count(*) FILTER (risk_level = 'high') AS high_risk_task_count,
      max(risk_score) AS max_risk_score, CAST((2 * sum(CAST(round(risk_score * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS avg_risk_score FROM risk GROUP BY 1, 2""")
def imp3_per_workflow(c: Catalog):
    return impact.per_workflow(hit_tasks(c, affected(c)))


_OVERALL = """tot AS (SELECT seed, count(*) AS n, count(DISTINCT dag_id) AS d, count(*) FILTER (risk_level IN ('high', 'critical')) AS k, avg(risk_score) * 0.4 + max(risk_score) * 0.6 AS o,
      avg((CASE WHEN criticality_score <> 0 THEN 1 ELSE 0 END + CASE WHEN success_rate <> 0 THEN 1 ELSE 0 END) / 4) AS f FROM risk GROUP BY 1),
    cols AS (SELECT seed, count(*) AS m FROM aff GROUP BY 1),
    overall AS (SELECT seed, m AS affected_columns, coalesce(n, 0) AS total_tasks, coalesce(d, 0) AS total_dags, coalesce(k, 0) AS critical_tasks,
      CASE WHEN n IS NULL THEN 'low' WHEN o >= 70 THEN 'critical' WHEN o >= 50 THEN 'high' WHEN o >= 30 THEN 'medium' ELSE 'low' END AS risk_level,
      CASE WHEN n IS NULL THEN 0.9 ELSE round((f * 40 + CASE WHEN n >= 10 THEN 30 WHEN n >= 5 THEN 20 ELSE 10 END + CASE WHEN m >= 10 THEN 30 WHEN m >= 5 THEN 20 WHEN m >= 1 THEN 10 ELSE 5 END) / 100, 2) END AS confidence_score
      FROM cols LEFT JOIN tot USING (seed))"""


@query("imp4_imp5_overall_risk", f"WITH {_AFFECTED}, {_OVERALL} SELECT * FROM overall")
def imp4_imp5_overall_risk(c: Catalog):
    found = affected(c)
    return impact.overall_risk(found, hit_tasks(c, found))


_IMP6 = """
    WITH walk AS (SELECT source_column_urn AS seed, target_column_urn AS node, transformation_type, 1 AS depth FROM v_column_edges
      UNION SELECT w.seed, e.target_column_urn, e.transformation_type, w.depth + 1 FROM walk w JOIN v_column_edges e ON e.source_column_urn = w.node WHERE w.depth < 10),
    a AS (SELECT seed, count(*) AS n, count(DISTINCT capsule_urn) AS caps, count(*) FILTER ({breaks}) AS b FROM walk JOIN v_column_nodes ON urn = node GROUP BY 1),
    t AS (SELECT column_urn AS seed, count(DISTINCT task_urn) AS t FROM v_task_column_edges GROUP BY 1),
    r AS (SELECT urn AS seed, coalesce(n, 0) AS affected_columns, coalesce(caps, 0) AS affected_capsules, coalesce(b, 0) AS breaking_changes, coalesce(t, 0) AS affected_tasks
      FROM v_column_nodes LEFT JOIN a ON a.seed = urn LEFT JOIN t ON t.seed = urn)
    SELECT *, CASE WHEN affected_columns = 0 THEN 'none' WHEN affected_columns < 5 AND breaking_changes = 0 THEN 'low' WHEN affected_columns < 10 AND breaking_changes < 3 THEN 'medium' ELSE 'high' END AS risk_level,
      '{change}' AS change_type FROM r"""


def _column_impact(c: Catalog, change: str):
    seeds = c.view("v_column_nodes").select(F.col("urn").alias("seed"))
    return impact.column_impact(c.view("v_column_edges"), c.view("v_column_nodes"), c.view("v_task_column_edges"), seeds, change)


@query("imp6_column_delete", _IMP6.format(breaks="depth = 1", change="delete"))
def imp6_column_delete(c: Catalog):
    return _column_impact(c, "delete")


@query("imp6_column_retype", _IMP6.format(breaks="transformation_type IN ('cast', 'arithmetic', 'string_transform')", change="type_change"))
def imp6_column_retype(c: Catalog):
    return _column_impact(c, "type_change")


@query("imp7_workflow_impact", " UNION ALL ".join(f"""
    SELECT pipeline_urn, CAST(count(*) AS BIGINT) AS directly_affected_capsules, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS total_downstream_impact, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS total_consuming_tasks, '{s}' AS scenario, '{r}' AS risk_level
    FROM v_task_edges e LEFT JOIN (SELECT seed, count(*) AS n FROM (
        SELECT source_urn AS seed, target_urn AS node FROM v_capsule_edges UNION SELECT a.source_urn, b.target_urn FROM v_capsule_edges a JOIN v_capsule_edges b ON b.source_urn = a.target_urn)
      WHERE seed <> node GROUP BY 1) b ON b.seed = e.capsule_urn
    LEFT JOIN (SELECT capsule_urn, count(*) AS n FROM v_task_edges WHERE edge_type = 'consumes' GROUP BY 1) k ON k.capsule_urn = e.capsule_urn
    WHERE edge_type IN ({kinds}) GROUP BY 1""" for s, r, kinds in (("modify", "medium", "'produces', 'transforms'"), ("disable", "high", "'produces'"), ("delete", "critical", "'produces', 'transforms'"))))
def imp7_workflow_impact(c: Catalog):
    below = staging.stage(impact.tables_below(c.view("v_task_edges"), c.view("v_capsule_edges")), staging.new_stage(c.spark, "below"))
    parts = [impact.workflow_impact(c.view("v_task_edges"), below, s) for s in impact.SCENARIOS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PRIORS = """types AS (SELECT DISTINCT change_type FROM v_changes UNION ALL SELECT DISTINCT 'comment' FROM v_changes),
    newest AS (SELECT * FROM v_changes QUALIFY row_number() OVER (PARTITION BY change_type ORDER BY change_timestamp DESC, change_id DESC) <= 10),
    known AS (SELECT change_type, count(*) AS matches, avg(CAST(coalesce(success, false) AS INTEGER)) AS r, avg(actual_downtime_seconds / 60) AS m FROM newest GROUP BY 1),
    priors AS (SELECT change_type, coalesce(matches, 0) AS matches, round(coalesce(r, CASE change_type WHEN 'delete' THEN 0.6 WHEN 'type_change' THEN 0.7 WHEN 'rename' THEN 0.75 WHEN 'nullability' THEN 0.85 WHEN 'default' THEN 0.95 ELSE 0.8 END), 6) AS success_rate,
      round(coalesce(m, 0), 6) AS avg_downtime_minutes FROM types LEFT JOIN known USING (change_type))"""


def priors(c: Catalog):
    changes = c.view("v_changes")
    types = changes.select("change_type").distinct().unionByName(changes.select(F.lit("comment").alias("change_type")).distinct())
    return impact.change_priors(changes, types)


@query("imp8_change_priors", f"WITH {_PRIORS} SELECT * FROM priors")
def imp8_change_priors(c: Catalog):
    return priors(c)


_SIMULATED = f"""{_PRIORS}, {_AFFECTED}, {_OVERALL}, sim AS (SELECT o.*, p.* FROM overall o, priors p)"""


def simulated(c: Catalog):
    found = affected(c)
    overall = impact.overall_risk(found, hit_tasks(c, found))
    known = sorted(priors(c).select("change_type", "matches", "success_rate").collect())  # a row for each change type, a handful
    each = [F.struct(F.lit(t).alias("change_type"), F.lit(n).alias("matches"), F.lit(rate).alias("success_rate")) for t, n, rate in known]
    return overall.withColumn("_prior", F.explode(F.array(*each))).select(*overall.columns, "_prior.*")


@query("imp9_confidence", f"""
    WITH {_SIMULATED} SELECT seed, change_type, round(least(1.0, confidence_score * 0.5 + CASE WHEN matches >= 10 THEN 0.3 WHEN matches >= 5 THEN 0.2 WHEN matches >= 2 THEN 0.1 ELSE 0 END + CASE WHEN total_tasks > 0 THEN 0.2 ELSE 0 END), 6) AS confidence FROM sim""")
def imp9_confidence(c: Catalog):
    value = impact.combined_confidence(F.col("confidence_score"), F.col("matches"), F.col("total_tasks") > 0)
    return simulated(c).select("seed", "change_type", F.round(value, 6).alias("confidence"))


@query("imp10_notes", f"""
    WITH {_SIMULATED}, w AS (SELECT *, risk_level IN ('critical', 'high') AS risky FROM sim)
    SELECT seed, change_type,
      concat_ws(',', CASE WHEN confidence_score < 0.7 THEN 'low_confidence' END, CASE WHEN change_type = 'type_change' THEN 'type_change_may_lose_data' END, CASE WHEN success_rate < 0.5 THEN 'most_similar_changes_failed' END,
        CASE WHEN total_dags > 10 THEN 'large_blast_radius' END) AS warnings,
      coalesce(nullif(concat_ws(',', CASE WHEN risky THEN 'test_in_staging' END, CASE WHEN risky AND critical_tasks > 0 THEN 'plan_rollback' END, CASE WHEN risky AND change_type = 'delete' THEN 'deprecate_first' END,
        CASE WHEN risky AND change_type = 'rename' THEN 'create_alias' END, CASE WHEN success_rate < 0.8 THEN 'review_past_failures' END, CASE WHEN total_tasks > 5 THEN 'notify_teams' END), ''), 'low_risk') AS recommendations FROM w""")
def imp10_notes(c: Catalog):
    rows = simulated(c).withColumn("best_window", F.lit(None).cast("string")).withColumn("executions_per_day", F.lit(0.0))
    return rows.select("seed", "change_type", F.array_join(impact.warnings(F.col("change_type")), ",").alias("warnings"), F.array_join(impact.recommendations(F.col("change_type")), ",").alias("recommendations"))


# -------------------------------------------------------------------- SLO


@query("slo_products", f"""
    WITH f AS (SELECT product, count(*) AS t, max(updated_at) AS u, sum(open_violations) AS v FROM v_products GROUP BY 1),
    a AS (SELECT p_brand AS product, round(avg(CAST(event_type <> 'error' AS INTEGER)) * 100, 4) AS availability FROM events JOIN part ON p_partkey = user_id GROUP BY 1),
    t AS (SELECT DISTINCT product, CASE WHEN product < 'Brand#2' THEN 24 * 31 WHEN product < 'Brand#3' THEN 240 END AS fh, CASE WHEN product < 'Brand#4' THEN 0.9 END AS q, CASE WHEN product > 'Brand#5' THEN 80.0 END AS av FROM v_data_products),
    r AS (SELECT product, epoch(TIMESTAMP '{NOW}' - u) / 3600 AS h, round(greatest(0, 1 - v / (t * 10)), 3) AS s, availability, fh, q, av FROM t LEFT JOIN f USING (product) LEFT JOIN a USING (product)),
    c AS (SELECT product, round(h, 2) AS hours_since_update, s AS quality_score, availability,
      CASE WHEN fh IS NOT NULL THEN CASE WHEN h IS NULL THEN 'warning' WHEN h <= fh * 0.8 THEN 'passing' WHEN h <= fh THEN 'warning' ELSE 'failing' END END AS freshness,
      CASE WHEN q IS NOT NULL THEN CASE WHEN s IS NULL THEN 'warning' WHEN s >= q THEN 'passing' WHEN s >= q - 0.1 THEN 'warning' ELSE 'failing' END END AS quality,
      CASE WHEN av IS NOT NULL THEN CASE WHEN availability IS NULL OR availability >= av THEN 'passing' ELSE 'failing' END END AS availability_status FROM r)
    SELECT *, CASE WHEN 'failing' IN (coalesce(freshness, ''), coalesce(quality, ''), coalesce(availability_status, '')) THEN 'failing' WHEN 'warning' IN (coalesce(freshness, ''), coalesce(quality, ''), coalesce(availability_status, '')) THEN 'warning'
      WHEN coalesce(freshness, quality, availability_status) IS NOT NULL THEN 'passing' ELSE 'not_configured' END AS overall FROM c""")
def slo_products(c: Catalog):
    p = F.col("product")
    products = c.view("v_data_products").select("product").distinct().select(
        "product", F.when(p < "Brand#2", 24 * 31).when(p < "Brand#3", 240).alias("slo_freshness_hours"),
        F.when(p < "Brand#4", 0.9).alias("slo_quality_threshold"), F.when(p > "Brand#5", 80.0).alias("slo_availability_percent"),
    )
    seen = c.table("events").join(c.table("part").select(F.col("p_partkey").alias("user_id"), F.col("p_brand").alias("product")), "user_id")
    return slo.check_products(products, c.view("v_products"), NOW, slo.availability(seen, "product", F.col("event_type") != "error"))
