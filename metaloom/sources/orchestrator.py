"""Orchestrator exports: workflows, tasks, their edges, and task-to-data edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions.classify import domain_of_tags, duration_seconds, operation_type, present, task_type, transformation_of
from metaloom.operators.joins import HOT_ROWS, fan_out, salt_rows
from metaloom.operators.rollups import resolve_columns
from metaloom.sources.accounting import Accounted, account
from metaloom.sources.json_records import parse_records, read_records
from metaloom.sources.manifest import select_models
from metaloom.staging import new_stage, stage

DELAY = "STRUCT<__var: STRUCT<days: INT, seconds: INT>>"
TASK = f"""STRUCT<task_id: STRING, operator_name: STRING, class_ref: STRUCT<class_name: STRING>, retries: INT, retry_delay: {DELAY}, execution_timeout: {DELAY},
  downstream_task_ids: ARRAY<STRING>, sql: STRING, params: MAP<STRING, STRING>>"""
DAG = f"dag_id STRING, description STRING, is_paused BOOLEAN, is_active BOOLEAN, schedule_interval STRING, owners ARRAY<STRING>, tags ARRAY<STRING>, tasks ARRAY<{TASK}>"
ITEM_LIST = "ARRAY<STRING>"
ANNOTATIONS = f"pipelines ARRAY<STRUCT<pipeline_id: STRING, instance: STRING, tasks: ARRAY<STRUCT<task_id: STRING, consumes: {ITEM_LIST}, produces: {ITEM_LIST}, transforms: {ITEM_LIST}, validates: {ITEM_LIST}>>>>"
ANNOTATED_EDGES = ["consumes", "produces", "transforms", "validates"]
#: model-name prefixes removed from task ids, in order (fixed values)
TASK_ID_PREFIXES = ["dbt_run_", "dbt_test_", "dbt_"]
#: operators whose SQL text is read (fixed values)
SQL_OPERATORS = ["sql", "postgres", "mysql", "snowflake", "bigquery", "redshift"]


#: names of layouts; records are found by their braces, so all are read alike
LAYOUTS = ("any", "objects", "lines")


def _read_json(spark: SparkSession, path: str, schema: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema`` with location and position, problems) of every object in the files at ``path``."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout} is not one of {', '.join(LAYOUTS)}")
    return parse_records(read_records(spark, path), schema)


def dags_of_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workflow exports, problems) of records from any reader, streams included. An object that lists workflows under ``dags`` stands for each of them."""
    rows, problems = parse_records(records, f"{DAG}, dags ARRAY<STRUCT<{DAG}>>")
    names = [x for x in rows.columns if x not in ("location", "position", "dags")]
    itself = F.array(F.struct(*names))
    each = rows.select("location", "position", F.explode(F.when(F.col("dags").isNotNull(), F.col("dags")).otherwise(itself)).alias("d"))
    return each.select("location", "position", "d.*"), problems


def parse_dags(spark: SparkSession, path: str, layout: str = "any") -> tuple[DataFrame, DataFrame]:
    """(workflow exports, problems) of the files at ``path``, see ``dags_of_records``."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout} is not one of {', '.join(LAYOUTS)}")
    return dags_of_records(read_records(spark, path))


def read_dags(spark: SparkSession, path: str, layout: str = "any") -> DataFrame:
    """One row per workflow export, however the files are laid out; see ``parse_dags`` for what can't be read."""
    return parse_dags(spark, path, layout)[0].drop("location", "position")


def _text_or_field(c: Column, field: str) -> Column:
    """A value given as text or as an object with ``field``."""
    return F.when(c.startswith("{"), F.get_json_object(c, f"$.{field}")).otherwise(c)


def included(dag_id: Column, is_paused: Column, is_active: Column, include_paused: bool = False, include_inactive: bool = False,
             allow: Sequence[str] | None = None, deny: Sequence[str] | None = None, pattern: str | None = None) -> Column:
    """Which workflows to read: state first, then allow list, deny list, pattern anchored at the start."""
    keep = F.lit(True)
    if pattern:
        keep = dag_id.rlike(f"^(?:{pattern})")
    if deny:
        keep = ~dag_id.isin(list(deny)) & keep
    if allow:
        keep = dag_id.isin(list(allow))
    hidden = F.lit(False)
    if not include_paused:
        hidden = hidden | F.coalesce(is_paused, F.lit(False))
    if not include_inactive:
        hidden = hidden | ~F.coalesce(is_active, F.lit(True))
    return ~hidden & keep


def workflows(dags: DataFrame, instance: str = "default", prefix: str = "urn:cat") -> DataFrame:
    """Catalog rows of workflows; tags and schedule as text or as objects."""
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: _text_or_field(t, "name")), lambda t: present(t))
    return dags.select(
        F.concat(F.lit(f"{prefix}:pipeline:airflow:{instance}:"), "dag_id").alias("urn"), F.col("dag_id").alias("name"), F.lit("airflow_dag").alias("pipeline_type"),
        F.coalesce("description", F.lit("")).alias("description"), _text_or_field(F.col("schedule_interval"), "value").alias("schedule_interval"), "owners",
        F.coalesce("is_paused", F.lit(False)).alias("is_paused"), F.coalesce("is_active", F.lit(True)).alias("is_active"), tags.alias("tags"), domain_of_tags(tags).alias("domain"),
    )


def _task_urn(prefix: str, instance: str, dag: Column, task: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:task:airflow:{instance}:"), dag, F.lit("."), task)


def tasks(dags: DataFrame, instance: str = "default", prefix: str = "urn:cat") -> DataFrame:
    rows = dags.select("dag_id", F.explode("tasks").alias("t"))
    operator = F.when(present(F.col("t.operator_name")), F.col("t.operator_name")).otherwise(F.coalesce("t.class_ref.class_name", F.lit("")))
    seconds = lambda c: F.when(F.col(c).isNotNull(), duration_seconds(F.col(f"{c}.__var.days"), F.col(f"{c}.__var.seconds")))
    return rows.select(
        _task_urn(prefix, instance, F.col("dag_id"), F.col("t.task_id")).alias("task_urn"), F.col("t.task_id").alias("name"),
        F.concat(F.lit(f"{prefix}:pipeline:airflow:{instance}:"), "dag_id").alias("pipeline_urn"), operator.alias("operator"), task_type(operator).alias("task_type"),
        operation_type(operator, F.col("t.task_id")).alias("operation_type"), F.coalesce("t.retries", F.lit(0)).alias("retries"),
        seconds("t.retry_delay").alias("retry_delay_seconds"), seconds("t.execution_timeout").alias("timeout_seconds"),
        F.coalesce("t.sql", F.try_element_at("t.params", F.lit("sql"))).alias("sql"), F.col("t.params").alias("params"),
    )


def task_edges(dags: DataFrame, instance: str = "default", prefix: str = "urn:cat") -> DataFrame:
    """contains (workflow → task) and depends_on (task → downstream task) edges."""
    rows = dags.select("dag_id", F.explode("tasks").alias("t"))
    own = _task_urn(prefix, instance, F.col("dag_id"), F.col("t.task_id"))
    contains = rows.select(F.concat(F.lit(f"{prefix}:pipeline:airflow:{instance}:"), "dag_id").alias("source_urn"), own.alias("target_urn"), F.lit("contains").alias("edge_type"))
    down = rows.select(own.alias("source_urn"), "dag_id", F.explode("t.downstream_task_ids").alias("d"))
    return contains.unionByName(down.select("source_urn", _task_urn(prefix, instance, F.col("dag_id"), F.col("d")).alias("target_urn"), F.lit("depends_on").alias("edge_type")))


def read_annotations(spark: SparkSession, path: str, layout: str = "any") -> DataFrame:
    return _read_json(spark, path, ANNOTATIONS, layout)[0].drop("location", "position")


def annotation_edges(annotations: DataFrame, prefix: str = "urn:cat") -> DataFrame:
    """(task_urn, capsule_urn, edge_type, detail) from annotation files; items are URNs or objects."""
    p = annotations.select(F.explode("pipelines").alias("p")).filter(present(F.col("p.pipeline_id")))
    t = p.select("p.pipeline_id", F.coalesce("p.instance", F.lit("default")).alias("instance"), F.explode("p.tasks").alias("t")).filter(present(F.col("t.task_id")))
    urn = F.concat(F.lit(f"{prefix}:task:airflow:"), "instance", F.lit(":"), "pipeline_id", F.lit("."), F.col("t.task_id"))

    def listed(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"t.{kind}"), F.array().cast("array<string>")), lambda i: F.struct(F.lit(kind).alias("edge_type"), i.alias("item")))

    lists = [listed(kind) for kind in ANNOTATED_EDGES]
    items = t.select(urn.alias("task_urn"), F.explode(F.concat(*lists)).alias("x")).select("task_urn", "x.edge_type", "x.item")
    detail = F.when(F.col("item").startswith("{"), F.coalesce(F.get_json_object("item", "$.operation"), F.get_json_object("item", "$.access_pattern")))
    return items.select("task_urn", _text_or_field(F.col("item"), "urn").alias("capsule_urn"), "edge_type", detail.alias("detail")).filter(present(F.col("capsule_urn")))


def checked_dags(dags: DataFrame) -> Accounted:
    """Workflow exports that have an id."""
    return account(dags, "workflows", [(present(F.col("dag_id")), "error", "workflow without an id")], F.col("location") if "location" in dags.columns else F.lit(""))


def checked_task_edges(dags: DataFrame, instance: str = "default", prefix: str = "urn:cat") -> Accounted:
    """depends_on edges, with a problem for each one to a task that its workflow doesn't have."""
    rows = dags.select("dag_id", F.explode("tasks").alias("t"))
    known = rows.select("dag_id", F.col("t.task_id").alias("d"), F.lit(True).alias("_known")).distinct()
    down = rows.select("dag_id", F.col("t.task_id").alias("task_id"), F.explode("t.downstream_task_ids").alias("d")).join(known, ["dag_id", "d"], "left")
    edges = down.select("_known", "dag_id", "task_id", "d", _task_urn(prefix, instance, F.col("dag_id"), F.col("task_id")).alias("source_urn"), _task_urn(prefix, instance, F.col("dag_id"), F.col("d")).alias("target_urn"), F.lit("depends_on").alias("edge_type"))
    got = account(edges, "task_edges", [(present(F.col("task_id")), "error", "task without an id"), (F.col("_known"), "warning", "unknown downstream task")], F.concat_ws(".", "dag_id", "task_id", "d"))
    return Accounted(got.kept.select("source_urn", "target_urn", "edge_type"), got.problems, got.counts)


def checked_annotations(annotated: DataFrame, capsules: DataFrame, prefix: str = "urn:cat") -> Accounted:
    """Annotated edges, with a problem for each URN that is malformed or that no table has."""
    rows = annotated.join(capsules.select(F.col("urn").alias("capsule_urn"), F.lit(True).alias("_known")), "capsule_urn", "left")
    checks = [(well_formed(F.col("capsule_urn"), prefix), "error", "malformed URN"), (F.col("_known"), "warning", "unknown table")]
    got = account(rows, "annotations", checks, F.concat_ws(" ", "task_urn", "edge_type", "capsule_urn"))
    return Accounted(got.kept.select(*annotated.columns), got.problems, got.counts)


def well_formed(urn: Column, prefix: str = "urn:cat") -> Column:
    return urn.rlike(f"^{prefix}:[^:]+:.+")


def unknown_references(annotated: DataFrame, capsules: DataFrame) -> DataFrame:
    """Annotated URNs that no table has."""
    return annotated.join(capsules.select(F.col("urn").alias("capsule_urn")), "capsule_urn", "left_anti").select("task_urn", "capsule_urn")


def malformed_urns(annotated: DataFrame, prefix: str = "urn:cat") -> DataFrame:
    return annotated.filter(~well_formed(F.col("capsule_urn"), prefix)).select("task_urn", "capsule_urn")


def model_edges(task_rows: DataFrame, nodes: DataFrame, node_urns: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(task_urn, capsule_urn, edge_type) of tasks that run models.

    The selector is the ``select`` or ``models`` parameter, else the task id
    without its prefix.  Selected models are produced, the models they depend
    on are consumed.  node_urns (unique_id, urn).  Tasks of a choice of selectors with
    more than ``hot_rows`` edges in all are split.
    """
    rest = F.col("name")
    for part in TASK_ID_PREFIXES:
        rest = F.replace(rest, F.lit(part), F.lit(""))
    chosen = F.coalesce(F.try_element_at("params", F.lit("select")), F.try_element_at("params", F.lit("models")), rest)
    runs = task_rows.filter(F.lower("operator").contains("dbt")).select("task_urn", chosen.alias("selector"))
    path = new_stage(nodes.sparkSession, "model-edges")
    # tasks with the same selectors have the same models: those are worked out once for a choice, and met by its tasks last
    choices = runs.where("selector IS NOT NULL").groupBy("task_urn").agg(F.array_sort(F.collect_set("selector")).alias("choice"))
    choices = stage(choices, f"{path}/choices")
    listed = choices.select("choice").distinct().select("choice", F.explode("choice").alias("selector"))
    picked = listed.join(select_models(listed.select("selector").distinct(), nodes), "selector").select("choice", "unique_id").distinct()
    picked = stage(picked, f"{path}/picked")
    models = nodes.filter(F.col("resource_type") == "model").select("unique_id", F.explode("depends_on").alias("dep")).filter(F.col("dep").startswith("model."))
    needed = picked.join(models, "unique_id").select("choice", F.col("dep").alias("unique_id")).distinct()
    both = picked.withColumn("edge_type", F.lit("produces")).unionByName(needed.withColumn("edge_type", F.lit("consumes")))
    found = stage(both.join(node_urns, "unique_id").select("choice", F.col("urn").alias("capsule_urn"), "edge_type"), f"{path}/found")
    sizes = choices.groupBy("choice").agg(F.count(F.lit(1)).alias("t")).join(found.groupBy("choice").agg(F.count(F.lit(1)).alias("m")), "choice")
    parts = F.least(F.ceil(F.col("t") * F.col("m") / hot_rows), F.col("t")).cast("int")
    hot = stage(sizes.where(F.col("t") * F.col("m") > hot_rows).select(F.col("choice").alias("_hot_key"), parts.alias("_parts")), f"{path}/hot")
    met = salt_rows(choices, "choice", hot, "task_urn").join(fan_out(found, "choice", hot), ["choice", "_salt"])
    return met.select("task_urn", "capsule_urn", "edge_type")


def first_source_wins(annotated: DataFrame, from_models: DataFrame, from_sql: DataFrame) -> DataFrame:
    """Edges of the best source per task: annotation, else model, else SQL text."""
    columns = ["task_urn", "capsule_urn", "edge_type"]
    ranked = [df.select(*columns, F.lit(i).alias("priority")) for i, df in enumerate((annotated, from_models, from_sql), 1)]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    best = rows.groupBy("task_urn").agg(F.min("priority").alias("priority"))
    return rows.join(best, ["task_urn", "priority"], "left_semi").select(*columns).distinct()


def sql_tasks(task_rows: DataFrame) -> DataFrame:
    """(task_urn, sql) of tasks whose operator runs SQL."""
    operator = F.lower("operator")
    runs_sql = operator.contains(SQL_OPERATORS[0])
    for part in SQL_OPERATORS[1:]:
        runs_sql = runs_sql | operator.contains(part)
    return task_rows.filter(runs_sql & present(F.col("sql"))).select("task_urn", "sql")


def column_mappings(mapped: DataFrame, capsules: DataFrame, columns: DataFrame) -> DataFrame:
    """Column edges of task expressions.

    mapped (task_urn, target_column, expression, source_columns, statement):
    qualified names, the SELECT, INSERT or UPDATE expression of the target, and
    its sources.  Names that do not resolve give no edge.  Of a task with
    several kinds of statements only the best counts.
    """
    typed = best_statement(mapped).select("task_urn", "target_column", F.explode("source_columns").alias("source_column"), transformation_of(F.col("expression"), F.col("statement")).alias("m"))
    names = typed.select(F.col("source_column").alias("qualified_name")).union(typed.select("target_column")).distinct()
    known = resolve_columns(names, capsules, columns)
    source = known.select(F.col("qualified_name").alias("source_column"), F.col("column_urn").alias("source_column_urn"))
    target = known.select(F.col("qualified_name").alias("target_column"), F.col("column_urn").alias("target_column_urn"))
    return typed.join(source, "source_column").join(target, "target_column").select(
        "task_urn", "source_column_urn", "target_column_urn", "m.transformation_type", "m.transformation_logic", "m.confidence", F.lit("sql_parser").alias("detected_by")
    )


def best_statement(mapped: DataFrame) -> DataFrame:
    """Per task, SELECT mappings, else INSERT, else UPDATE."""
    rank = F.when(F.col("statement") == "select", 1).when(F.col("statement") == "insert", 2).otherwise(3)
    ranked = mapped.withColumn("_r", rank)
    best = ranked.groupBy("task_urn").agg(F.min("_r").alias("_r"))
    return ranked.join(best, ["task_urn", "_r"], "left_semi").select(*mapped.columns)
