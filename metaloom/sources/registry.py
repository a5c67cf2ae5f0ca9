"""Pluggable sources: a name maps to a function that returns catalog tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Source:
    read: Callable[[SparkSession, Mapping[str, object]], Tables]
    required: tuple[str, ...] = ()


SOURCES: dict[str, Source] = {}


def register(name: str, read: Callable[[SparkSession, Mapping[str, object]], Tables], required: tuple[str, ...] = ()) -> None:
    SOURCES[name] = Source(read, required)


def load(spark: SparkSession, name: str, config: Mapping[str, object]) -> Tables:
    """Read a source; a missing configuration entry is an error before anything is read."""
    source = SOURCES[name]
    missing = [k for k in source.required if not config.get(k)]
    if missing:
        raise ValueError(f"source {name}: {', '.join(missing)} is required")
    return source.read(spark, config)


def _manifest(spark: SparkSession, config: Mapping[str, object]) -> Tables:
    from metaloom.sources import manifest as m

    nodes = m.read_nodes(spark, config["manifest_path"], config.get("project_name"))
    catalog = m.read_catalog(spark, config["catalog_path"]) if config.get("catalog_path") else None
    given = {k: config[k] for k in ("layer_names", "layer_paths") if config.get(k)}
    capsules = m.capsules(nodes, **given)
    columns = m.columns(nodes, catalog, **({"pii_patterns": config["pii_patterns"]} if config.get("pii_patterns") else {}))
    return {
        "nodes": nodes, "capsules": capsules, "columns": columns, "edges": m.edges(nodes), "column_edges": m.column_edges(nodes, columns),
        "domains": m.domains(capsules), "tags": m.tags(capsules, columns), "problems": m.parse_problems(spark, config["manifest_path"]),
    }


def _orchestrator(spark: SparkSession, config: Mapping[str, object]) -> Tables:
    from pyspark.sql import functions as F

    from metaloom.sources import orchestrator as o

    instance = str(config.get("instance", "default"))
    dags, problems = o.parse_dags(spark, str(config["path"]), str(config.get("layout", "any")))
    dags = dags.drop("location", "position")
    dags = dags.filter(o.included(F.col("dag_id"), F.col("is_paused"), F.col("is_active"), **dict(config.get("filters", {}))))
    tasks = o.tasks(dags, instance)
    out = {"workflows": o.workflows(dags, instance), "tasks": tasks, "task_edges": o.task_edges(dags, instance), "problems": problems}
    # data edges of tasks, where the configuration names what they refer to: annotation, else model, else SQL text
    none = spark.createDataFrame([], "task_urn string, capsule_urn string, edge_type string")
    annotated = from_models = from_sql = none
    if config.get("annotations_path"):
        annotated = o.annotation_edges(o.read_annotations(spark, str(config["annotations_path"]), str(config.get("annotations_layout", "any"))))
        out["malformed_urns"] = o.malformed_urns(annotated)
    if config.get("manifest_path"):
        from metaloom.sources import manifest as m

        nodes = m.read_nodes(spark, config["manifest_path"], config.get("project_name"))
        from_models = o.model_edges(tasks, nodes, m.capsules(nodes).select("unique_id", "urn"))
    if config.get("tables_path"):
        from metaloom.sources import warehouse as w

        known = w.capsules(w.tables(spark.read.parquet(str(config["tables_path"]))))
        from_sql = w.task_sql_edges(o.sql_tasks(tasks), known, str(config.get("database", "")), str(config.get("schema", "public")))
        if config.get("annotations_path"):
            out["unknown_references"] = o.unknown_references(annotated, known)
    if any(config.get(k) for k in ("annotations_path", "manifest_path", "tables_path")):
        out["data_edges"] = o.first_source_wins(annotated, from_models, from_sql)
    return out


def _warehouse(spark: SparkSession, config: Mapping[str, object]) -> Tables:
    from metaloom.sources import warehouse as w

    tables = w.tables(spark.read.parquet(str(config["tables_path"])), since=config.get("since"))
    capsules = w.capsules(tables)
    columns = w.catalog_columns(w.columns(spark.read.parquet(str(config["columns_path"]))), capsules)
    if config.get("tags_path"):
        columns = w.apply_tags(columns, spark.read.parquet(str(config["tags_path"])))
    out = {"capsules": capsules, "columns": columns}
    if config.get("access_log_path"):
        out["edges"] = w.access_lineage(spark.read.parquet(str(config["access_log_path"])), capsules, str(config["now"]), int(config.get("lookback_days", 7)))
    if config.get("ddl_path"):
        out["view_edges"] = w.view_lineage(spark.read.parquet(str(config["ddl_path"])), capsules)
    return out


register("manifest", _manifest, ("manifest_path",))
register("orchestrator", _orchestrator, ("path",))
register("warehouse", _warehouse, ("tables_path", "columns_path"))
