"""Transformation-project manifests (dbt JSON artefacts) as catalog tables.

``read_nodes`` reads any number of manifest files with a fixed schema; all
other functions work on the node table, so they run on any source of nodes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.classify import LAYER_NAME_PATTERNS, LAYER_PATH_PATTERNS, PII_NAME_PATTERNS, detect_pii, infer_domain, infer_layer, present, semantic_type, table_urn
from metaloom.operators.substring_index import containing
from metaloom.sources.accounting import Accounted, account

Patterns = Mapping[str, Sequence[str]]

COLUMN = "STRUCT<name: STRING, description: STRING, meta: MAP<STRING, STRING>, tags: ARRAY<STRING>, data_tests: ARRAY<STRING>, depends_on: ARRAY<STRING>>"
NODE = f"""STRUCT<resource_type: STRING, name: STRING, alias: STRING, database: STRING, schema: STRING, source_name: STRING, package_name: STRING, original_file_path: STRING,
  description: STRING, tags: ARRAY<STRING>, meta: MAP<STRING, STRING>, config: STRUCT<materialized: STRING, meta: MAP<STRING, STRING>>,
  depends_on: STRUCT<nodes: ARRAY<STRING>, columns: MAP<STRING, ARRAY<STRING>>>, columns: MAP<STRING, {COLUMN}>, data_tests: ARRAY<STRING>,
  catalog_col_lineage: STRING, raw_code: STRING>"""
MANIFEST = f"metadata STRUCT<project_name: STRING, dbt_version: STRING>, nodes MAP<STRING, {NODE}>, sources MAP<STRING, {NODE}>"
CATALOG_NODE = "STRUCT<columns: MAP<STRING, STRUCT<type: STRING, index: INT, stats: MAP<STRING, STRUCT<value: STRING, label: STRING>>>>>"
CATALOG = f"nodes MAP<STRING, {CATALOG_NODE}>, sources MAP<STRING, {CATALOG_NODE}>"

# Node kinds that become tables, and those whose layer is given
KINDS = ["model", "source", "seed", "snapshot"]
FIXED_LAYER_KINDS = ["source", "seed"]
FIXED_LAYER = "bronze"


def _read(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    bad = f"{schema}, _corrupt_record STRING"
    return spark.read.schema(bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths if isinstance(paths, str) else list(paths))


def read_nodes(spark: SparkSession, paths: str | Sequence[str], project: str | None = None, kinds: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """One row per model, source, seed or snapshot of the manifests at ``paths``."""
    raw = _read(spark, paths, MANIFEST)
    name = F.coalesce(F.lit(project), F.col("metadata.project_name"), F.lit("default"))
    rows = raw.select(name.alias("project"), F.explode("nodes").alias("unique_id", "n")).unionByName(raw.select(name.alias("project"), F.explode("sources").alias("unique_id", "n")))
    kind = F.coalesce("n.resource_type", F.substring_index("unique_id", ".", 1))
    return rows.withColumn("resource_type", kind).filter(F.col("resource_type").isin(list(kinds))).select(
        "project", "unique_id", "resource_type", F.col("n.name").alias("name"), F.coalesce("n.schema", F.lit("default")).alias("schema_name"),
        F.coalesce(F.when(F.col("resource_type") == "source", F.col("n.source_name")), F.col("n.schema"), F.lit("default")).alias("namespace"), F.col("n.database").alias("database_name"),
        F.col("n.package_name").alias("package_name"), F.col("n.original_file_path").alias("path"), F.col("n.description").alias("description"), F.coalesce("n.tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.size("n.config.meta") > 0, F.col("n.config.meta")).otherwise(F.col("n.meta")).alias("meta"), F.col("n.config.materialized").alias("materialization"),
        F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), F.col("n.depends_on.columns").alias("depends_on_columns"),
        F.col("n.columns").alias("columns"), F.coalesce("n.data_tests", F.array().cast("array<string>")).alias("data_tests"), F.col("n.catalog_col_lineage").alias("catalog_col_lineage"),
    )


def parse_problems(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(location, severity, message) of manifests that are not readable JSON."""
    raw = _read(spark, paths, MANIFEST)
    located = raw.select(F.input_file_name().alias("location"), "_corrupt_record", "nodes")
    return located.filter(F.col("_corrupt_record").isNotNull() | F.col("nodes").isNull()).select(
        "location", F.lit("error").alias("severity"), F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON").otherwise("no nodes").alias("message")
    )


def problem_counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("severity").agg(F.count("*").alias("n"))


def read_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(unique_id, key, column_name, data_type, position, stats): catalog columns, key in lower case."""
    raw = _read(spark, paths, CATALOG)
    nodes = raw.select(F.explode("nodes").alias("unique_id", "n")).unionByName(raw.select(F.explode("sources").alias("unique_id", "n")))
    cols = nodes.select("unique_id", F.explode("n.columns").alias("column_name", "c"))
    return cols.select(
        "unique_id", F.lower("column_name").alias("key"), "column_name", F.col("c.type").alias("data_type"), F.col("c.index").alias("position"),
        F.transform_values("c.stats", lambda _, s: s["value"]).alias("stats"),
    )


def _node_urn(prefix: str):
    return table_urn(prefix, F.col("resource_type"), F.concat_ws(".", "project", "namespace"), F.col("name"))


def capsules(nodes: DataFrame, prefix: str = "urn:cat:dbt", layer_names: Patterns = LAYER_NAME_PATTERNS, layer_paths: Patterns = LAYER_PATH_PATTERNS) -> DataFrame:
    """Catalog rows of nodes: layer (by patterns of names and paths), domain, tests."""
    tests = F.size("data_tests") + F.aggregate(F.transform(F.coalesce(F.map_values("columns"), F.array()), lambda c: F.size(F.coalesce(c["data_tests"], F.array()))), F.lit(0), lambda a, b: a + b)
    inferred = infer_layer(F.col("name"), F.col("path"), F.col("tags"), F.col("meta"), layer_names, layer_paths)
    layer = F.when(F.col("resource_type").isin(FIXED_LAYER_KINDS), FIXED_LAYER).otherwise(inferred)
    return nodes.select(
        _node_urn(prefix).alias("urn"), "name", F.col("resource_type").alias("capsule_type"), "unique_id", layer.alias("layer"),
        infer_domain(F.col("path"), F.col("tags"), F.col("meta")).alias("domain"), "database_name", "schema_name", "description", "materialization", "tags",
        (tests > 0).alias("has_tests"), tests.alias("test_count"),
    )


def columns(nodes: DataFrame, catalog: DataFrame | None = None, prefix: str = "urn:cat:dbt", pii_patterns: Patterns = PII_NAME_PATTERNS) -> DataFrame:
    """Columns declared in nodes, merged with catalog columns by lower-case name."""
    owners = nodes.select("unique_id", _node_urn(prefix).alias("capsule_urn"))
    declared = nodes.select("unique_id", F.explode("columns").alias("column_name", "c")).select(
        "unique_id", F.lower("column_name").alias("key"), F.col("column_name").alias("declared_name"), F.col("c.description").alias("description"),
        F.coalesce("c.meta", F.create_map().cast("map<string,string>")).alias("meta"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"),
        F.size(F.coalesce("c.data_tests", F.array())).alias("test_count"),
    )
    if catalog is None:
        merged = declared.withColumns({"name": F.col("declared_name"), "data_type": F.lit(None).cast("string"), "position": F.lit(None).cast("int"), "stats": F.lit(None).cast("map<string,string>")})
    else:
        merged = declared.join(catalog.join(owners.select("unique_id"), "unique_id", "left_semi"), ["unique_id", "key"], "full_outer").withColumn("name", F.coalesce("declared_name", "column_name"))
    pii = detect_pii(F.col("name"), F.col("meta"), F.col("tags"), pii_patterns)
    typed = merged.join(owners, "unique_id").withColumn("_pii", pii)
    return typed.select(
        F.concat_ws(".", "capsule_urn", "name").alias("urn"), "capsule_urn", "unique_id", "name", "data_type", "position", F.col("_pii.pii_type").alias("pii_type"),
        F.col("_pii.detected_by").alias("pii_detected_by"), semantic_type(F.col("name"), F.col("_pii.pii_type"), F.col("meta")).alias("semantic_type"),
        "description", "tags", "stats", (F.coalesce("test_count", F.lit(0)) > 0).alias("has_tests"), F.coalesce("test_count", F.lit(0)).alias("test_count"),
    )


def edges(nodes: DataFrame, prefix: str = "urn:cat:dbt") -> DataFrame:
    """Table edges from declared dependencies; unknown ids are dropped."""
    known = nodes.select(F.col("unique_id").alias("dep"), _node_urn(prefix).alias("source_urn"))
    wanted = nodes.select(_node_urn(prefix).alias("target_urn"), F.explode("depends_on").alias("dep"))
    return wanted.join(known, "dep").select("source_urn", "target_urn", F.lit("flows_to").alias("edge_type"), _dependency_kind().alias("transformation"))


def _dependency_kind() -> Column:
    kind = F.substring_index("dep", ".", 1)
    return F.when(kind == "source", "source").when(kind.isin("model", "seed"), "ref").otherwise("dependency")


def checked_capsules(nodes: DataFrame, prefix: str = "urn:cat:dbt") -> Accounted:
    """``capsules``, without nodes that have no name."""
    return account(capsules(nodes, prefix), "capsules", [(present(F.col("name")), "error", "node without a name")], F.col("unique_id"))


def checked_edges(nodes: DataFrame, prefix: str = "urn:cat:dbt") -> Accounted:
    """``edges``, with a problem for each dependency on a node that isn't there."""
    known = nodes.select(F.col("unique_id").alias("dep"), _node_urn(prefix).alias("source_urn"))
    wanted = nodes.select("unique_id", _node_urn(prefix).alias("target_urn"), F.explode("depends_on").alias("dep"))
    rows = wanted.join(known, "dep", "left").select("unique_id", "dep", "source_urn", "target_urn", F.lit("flows_to").alias("edge_type"), _dependency_kind().alias("transformation"))
    return account(rows, "edges", [(F.col("source_urn").isNotNull(), "warning", "unknown node")], F.concat_ws(" -> ", "dep", "unique_id"))


def checked_columns(nodes: DataFrame, catalog: DataFrame) -> Accounted:
    """Rows of the catalog; those of nodes that the manifest doesn't have are dropped."""
    known = nodes.select("unique_id", F.lit(True).alias("_known"))
    rows = catalog.join(known, "unique_id", "left")
    checks = [(F.col("_known"), "warning", "catalog node not in the manifest"), (present(F.col("column_name")), "error", "column without a name")]
    got = account(rows, "catalog_columns", checks, F.concat_ws(".", "unique_id", "column_name"))
    return Accounted(got.kept.drop("_known"), got.problems, got.counts)


def checked_column_edges(nodes: DataFrame, node_columns: DataFrame) -> Accounted:
    """``column_edges``, with a problem for each reference whose column isn't there."""
    checks = [(F.col("target_column_urn").isNotNull(), "warning", "unknown target column"), (F.col("source_column_urn").isNotNull(), "warning", "unknown source column")]
    return account(_column_references(nodes, node_columns), "column_edges", checks, F.concat(F.concat_ws(".", "source_id", "source"), F.lit(" -> "), F.concat_ws(".", "unique_id", "target")))


def column_edges(nodes: DataFrame, node_columns: DataFrame) -> DataFrame:
    """Column edges from the three places a manifest may declare them; references to unknown columns are dropped."""
    return _column_references(nodes, node_columns).where("source_column_urn IS NOT NULL AND target_column_urn IS NOT NULL").select("source_column_urn", "target_column_urn", "transformation_type")


def _column_references(nodes: DataFrame, node_columns: DataFrame) -> DataFrame:
    """Declared column references: unique_id, target, source_id, source, transformation_type, and the URNs of both ends where they are known."""
    dotted = r"^(.*)\.([^.]+)$"
    ref = lambda c: (F.regexp_extract(c, dotted, 1), F.lower(F.regexp_extract(c, dotted, 2)))

    def of_refs(rows: DataFrame, kind: str) -> DataFrame:
        node, column = ref(F.col("ref"))
        return rows.select("unique_id", "target", node.alias("source_id"), column.alias("source"), F.lit(kind).alias("transformation_type"))

    by_node = nodes.select("unique_id", F.explode("depends_on_columns").alias("target", "refs")).select("unique_id", "target", F.explode("refs").alias("ref"))
    by_column = nodes.select("unique_id", F.explode("columns").alias("target", "c")).select("unique_id", "target", F.explode("c.depends_on").alias("ref"))
    nested = F.from_json("catalog_col_lineage", "columns MAP<STRING, STRING>")["columns"]
    flat = F.from_json("catalog_col_lineage", "MAP<STRING, STRING>")
    listed = nodes.filter(F.col("catalog_col_lineage").isNotNull()).select("unique_id", F.explode(F.coalesce(nested, flat)).alias("target", "text"))
    items = F.when(F.col("text").startswith("["), F.from_json("text", "ARRAY<STRING>")).otherwise(F.from_json("text", "sources ARRAY<STRING>")["sources"])
    item = listed.select("unique_id", "target", F.explode(items).alias("item"))
    spec = F.from_json("item", "node STRING, unique_id STRING, `column` STRING, name STRING, transformation STRING")
    node, column = ref(F.col("item"))
    is_object = F.col("item").startswith("{")
    by_catalog = item.select(
        "unique_id", "target", F.when(is_object, F.coalesce(spec["node"], spec["unique_id"])).otherwise(node).alias("source_id"),
        F.when(is_object, F.lower(F.coalesce(spec["column"], spec["name"]))).otherwise(column).alias("source"), F.coalesce(spec["transformation"], F.lit("transform")).alias("transformation_type"),
    )
    found = of_refs(by_node, "transform").unionByName(by_catalog).unionByName(of_refs(by_column, "passthrough"))
    names = node_columns.select("unique_id", F.lower("name").alias("k"), "urn")
    source = names.select(F.col("unique_id").alias("source_id"), F.col("k").alias("source"), F.col("urn").alias("source_column_urn"))
    target = names.select("unique_id", F.col("k").alias("_target"), F.col("urn").alias("target_column_urn"))
    return found.withColumn("_target", F.lower("target")).join(target, ["unique_id", "_target"], "left").join(source, ["source_id", "source"], "left").drop("_target")


def domains(node_capsules: DataFrame) -> DataFrame:
    return node_capsules.filter(F.col("domain").isNotNull()).select(F.col("domain").alias("name")).distinct()


def tags(node_capsules: DataFrame, node_columns: DataFrame) -> DataFrame:
    """Distinct tags of tables and columns with their category."""
    every = node_capsules.select(F.explode("tags").alias("name")).union(node_columns.select(F.explode("tags").alias("name"))).distinct()
    return every.withColumn("category", F.when(F.col("name").startswith("pii"), "sensitivity").when(F.col("name").startswith("domain:"), "domain"))


def select_models(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(selector, unique_id): models picked by ``tag:x``, ``package.model``, ``path*`` or a name.

    Keyed joins; paths, which stand anywhere in an id, go through the substring index.
    """
    models = nodes.filter(F.col("resource_type") == "model")
    s = F.col("selector")
    tag, path = s.startswith("tag:"), s.contains("*")
    package = ~tag & s.contains(".") & ~s.endswith("*")
    by_tag = selectors.filter(tag).select("selector", F.substr(s, F.lit(5)).alias("t")).join(models.select("unique_id", F.explode("tags").alias("t")).distinct(), "t")
    by_package = selectors.filter(package).select("selector", F.substring_index(s, ".", 1).alias("package_name"), F.substr(s, F.instr(s, ".") + 1).alias("name")).join(
        models.select("unique_id", "package_name", "name"), ["package_name", "name"])
    by_name = selectors.filter(~tag & ~package & ~path).select("selector", s.alias("name")).join(models.select("unique_id", "name"), "name")
    patterns = selectors.filter(~tag & ~package & path).select("selector", F.lower(F.regexp_replace(s, r"[/*]+$", "")).alias("_p"))
    texts = models.select(F.col("unique_id").alias("id"), F.lower("unique_id").alias("text"))
    by_path = containing(texts, patterns.select(F.col("_p").alias("pattern"))).select(F.col("pattern").alias("_p"), F.col("id").alias("unique_id")).join(patterns, "_p")
    parts = [x.select("selector", "unique_id") for x in (by_tag, by_package, by_name, by_path)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
