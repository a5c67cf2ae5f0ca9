"""Classification and PII queries."""

from pyspark.sql import functions as F

from metaloom.functions import classify
from metaloom.operators import lineage, pii
from metaloom.plans.registry import Catalog, query

# Oracle side of the classification rules, written as SQL over one column.


def _rx(column: str, patterns) -> str:
    return f"regexp_matches({column}, '{'|'.join(patterns)}', 'i')"


def _case(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _has(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


PII_SQL = _case([(_rx("name", p), f"'{k}'") for k, p in classify.PII_NAME_PATTERNS.items()])
SUBSTRING_SQL = _case([(_has("lower(name)", p), f"'{k}'") for k, p in classify.PII_NAME_SUBSTRINGS.items()])
LAYER_SQL = _case([(_rx("name", p), f"'{k}'") for k, p in classify.LAYER_NAME_PATTERNS.items()])
MASKED_SQL = _has("lower(name)", classify.MASKED_NAME_PARTS)
SEVERITY_SQL = _case([(f"pii_type = '{k}'", f"'{v}'") for k, v in classify.PII_SEVERITY.items()], "'medium'")
SEMANTIC_SQL = f"""CASE WHEN pii_type IS NOT NULL THEN 'pii'
  WHEN (name LIKE '%\\_id' ESCAPE '\\' OR name LIKE '%\\_key' ESCAPE '\\') THEN 'foreign_key'
  WHEN name IN ('id', 'pk', 'primary_key') OR name LIKE '%\\_pk' ESCAPE '\\' THEN 'surrogate_key'
  WHEN {_has('lower(name)', classify.TIMESTAMP_PARTS)} THEN 'timestamp'
  WHEN {_has('lower(name)', classify.METRIC_PARTS)} THEN 'metric' END"""
TAGGED_SQL = f"tagged AS (SELECT *, {PII_SQL} AS pii_type FROM v_columns), found AS (SELECT t.*, c.name AS capsule_name, c.layer, c.domain FROM tagged t JOIN v_capsules c ON c.urn = t.capsule_urn WHERE pii_type IS NOT NULL)"


def tagged(c: Catalog):
    return pii.tag_columns(c.view("v_columns"))


def found(c: Catalog):
    return pii.pii_columns(tagged(c), c.view("v_capsules"))


@query("f1_normalize_name", """
    SELECT urn, trim(replace(replace(regexp_replace(lower(name), '^(stg_|staging_|int_|intermediate_|dim_|fct_|rpt_|raw_)', ''), '_', ''), '-', '')) AS normal_name FROM v_capsules""")
def f1_normalize_name(c: Catalog):
    return c.view("v_capsules").select("urn", classify.normalize_name(F.col("name")).alias("normal_name"))


@query("f2_is_masked", f"SELECT urn, {MASKED_SQL} AS masked FROM v_columns UNION ALL SELECT urn, {MASKED_SQL} FROM v_column_nodes")
def f2_is_masked(c: Catalog):
    both = c.view("v_columns").select("urn", "name").unionByName(c.view("v_column_nodes").select("urn", "name"))
    return both.select("urn", classify.is_masked(F.col("name")).alias("masked"))


@query("f3_pii_severity", f"SELECT urn, pii_type, {SEVERITY_SQL} AS severity FROM (SELECT urn, coalesce({PII_SQL}, 'other') AS pii_type FROM v_columns)")
def f3_pii_severity(c: Catalog):
    kinds = tagged(c).select("urn", F.coalesce("pii_type", F.lit("other")).alias("pii_type"))
    return kinds.withColumn("severity", classify.pii_severity(F.col("pii_type")))


@query("f4_detect_pii", f"""
    SELECT urn, CASE WHEN tag = 'pii' THEN 'unknown' ELSE {PII_SQL} END AS pii_type,
      CASE WHEN tag = 'pii' THEN 'tag' WHEN {PII_SQL} IS NOT NULL THEN 'pattern' END AS pii_detected_by
    FROM (SELECT urn, name, CASE WHEN variant = 6 THEN 'pii' ELSE 'plain' END AS tag FROM v_columns)""")
def f4_detect_pii(c: Catalog):
    rows = c.view("v_columns").withColumn("tags", F.array(F.when(F.col("variant") == 6, "PII").otherwise("plain")))
    return pii.tag_columns(rows, tags="tags").select("urn", "pii_type", "pii_detected_by")


@query("f5_infer_layer", f"""
    SELECT urn, CASE WHEN tag = 'mart' THEN 'gold' ELSE {LAYER_SQL} END AS inferred_layer
    FROM (SELECT urn, name, CASE WHEN capsule_type = 'small' THEN 'mart' END AS tag FROM v_capsules)""")
def f5_infer_layer(c: Catalog):
    tag = F.when(F.col("capsule_type") == "small", F.array(F.lit("x"), F.lit("Mart"))).otherwise(F.array(F.lit("x")))
    return c.view("v_capsules").select("urn", classify.infer_layer(F.col("name"), tags=tag).alias("inferred_layer"))


@query("f6_infer_pii_type", f"SELECT urn, {SUBSTRING_SQL} AS pii_type FROM v_columns")
def f6_infer_pii_type(c: Catalog):
    return c.view("v_columns").select("urn", classify.infer_pii_type(F.col("name")).alias("pii_type"))


@query("f7_layer_of_schema", """
    SELECT DISTINCT schema_name, CASE WHEN regexp_matches(schema_name, '^(raw|landing|bronze|stage|l1)|_raw$|_landing$', 'i') THEN 'bronze'
      WHEN regexp_matches(schema_name, '^(staging|stg|silver|intermediate|int|l2)|_staging$|_stg$', 'i') THEN 'silver'
      WHEN regexp_matches(schema_name, '^(mart|marts|gold|analytics|prod|l3|presentation)|_(mart|marts)$|_analytics$', 'i') THEN 'gold' END AS layer
    FROM v_wh_tables""")
def f7_layer_of_schema(c: Catalog):
    return c.view("v_wh_tables").select("schema_name").distinct().withColumn("layer", classify.layer_of_schema(F.col("schema_name")))


@query("f8_infer_domain", """
    SELECT file_path, CASE split_part(file_path, '/', 2) WHEN 'prep' THEN NULL ELSE split_part(file_path, '/', 2) END AS domain FROM v_code""")
def f8_infer_domain(c: Catalog):
    return c.view("v_code").select("file_path", classify.infer_domain(F.col("file_path")).alias("domain"))


@query("f9_semantic_type", f"SELECT urn, {SEMANTIC_SQL} AS semantic_type FROM (SELECT urn, name, {PII_SQL} AS pii_type FROM v_columns)")
def f9_semantic_type(c: Catalog):
    return tagged(c).select("urn", classify.semantic_type(F.col("name"), F.col("pii_type")).alias("semantic_type"))


@query("f12_urns", """
    SELECT concat_ws(':', 'urn:cat', lower(p_type), p_brand, p_name) AS urn,
      replace(replace(replace(concat_ws(':', 'urn:cat', lower(p_type), p_brand, p_name), ':', '_'), '.', '_'), '-', '_') AS safe_id FROM part""")
def f12_urns(c: Catalog):
    urn = classify.table_urn("urn:cat", F.lower("p_type"), F.col("p_brand"), F.col("p_name"))
    return c.table("part").select(urn.alias("urn"), classify.safe_id(urn).alias("safe_id"))


@query("f20_standard_types", """
    SELECT DISTINCT data_type, table_type,
      CASE WHEN contains(data_type, 'NUMBER') AND contains(data_type, ',0)') THEN 'INTEGER' WHEN contains(data_type, 'NUMBER') THEN 'DECIMAL'
        WHEN data_type LIKE 'VARCHAR%' OR data_type = 'TEXT' THEN 'STRING' WHEN data_type LIKE 'TIMESTAMP%LTZ%' THEN 'TIMESTAMP_TZ'
        WHEN data_type = 'VARIANT' THEN 'JSON' WHEN data_type = 'OBJECT' THEN 'STRUCT' ELSE data_type END AS standard_type,
      CASE table_type WHEN 'VIEW' THEN 'view' WHEN 'MATERIALIZED VIEW' THEN 'materialized_view' WHEN 'EXTERNAL TABLE' THEN 'external_table' ELSE 'table' END AS table_kind
    FROM v_wh_columns JOIN v_wh_tables USING (database_name, schema_name, table_name)""")
def f20_standard_types(c: Catalog):
    rows = c.view("v_wh_columns").join(c.view("v_wh_tables"), ["database_name", "schema_name", "table_name"])
    return rows.select("data_type", "table_type").distinct().select(
        "data_type", "table_type", classify.standard_type(F.col("data_type")).alias("standard_type"), classify.table_kind(F.col("table_type")).alias("table_kind")
    )


@query("f24_dependency_types", """
    SELECT edge_type, CASE edge_type WHEN 'produces' THEN 'write' WHEN 'transforms' THEN 'transform' ELSE 'read' END AS dependency_type, count(*) AS edges
    FROM v_task_edges GROUP BY ALL""")
def f24_dependency_types(c: Catalog):
    typed = c.view("v_task_edges").withColumn("dependency_type", classify.dependency_type(F.col("edge_type")))
    return typed.groupBy("edge_type", "dependency_type").agg(F.count("*").alias("edges"))


@query("pii1_inventory_by_type", f"""
    WITH {TAGGED_SQL} SELECT pii_type, count(*) AS column_count, count(DISTINCT capsule_urn) AS capsule_count,
      array_to_string(list_sort(list(DISTINCT layer)), ',') AS layers FROM found GROUP BY pii_type""")
def pii1_inventory_by_type(c: Catalog):
    return pii.inventory_by_type(found(c))


@query("pii1_inventory_by_layer", f"""
    WITH {TAGGED_SQL} SELECT coalesce(layer, 'unknown') AS layer, count(*) AS column_count, count(DISTINCT capsule_urn) AS capsule_count,
      array_to_string(list_sort(list(DISTINCT pii_type)), ',') AS pii_types FROM found GROUP BY 1""")
def pii1_inventory_by_layer(c: Catalog):
    return pii.inventory_by_layer(found(c))


@query("pii1_inventory_totals", f"""
    WITH {TAGGED_SQL} SELECT count(*) AS total_pii_columns, count(DISTINCT capsule_urn) AS capsules_with_pii,
      array_to_string(list_sort(list(DISTINCT pii_type)), ',') AS pii_types_found FROM found""")
def pii1_inventory_totals(c: Catalog):
    return pii.inventory_totals(found(c))


def _exposed(reason: str, recommendation: str) -> str:
    return f"""{TAGGED_SQL}, exposed AS (SELECT urn AS column_urn, name AS column_name, pii_type, capsule_urn, capsule_name, layer, {SEVERITY_SQL} AS severity,
      {reason} AS reason, {recommendation} AS recommendation
      FROM found WHERE layer IN ('gold', 'marts', 'mart', 'consumption', 'reporting', 'analytics') AND NOT {MASKED_SQL})"""


_EXPOSED = _exposed("'unmasked_where_consumed'", "'protect_column'")  # where only the rows are counted
_ADVISED = _exposed("concat('Unmasked ', pii_type, ' PII in ', layer, ' layer')", "concat('Apply masking, hashing, or encryption to ', name)")


@query("pii2_exposures", f"WITH {_ADVISED} SELECT * FROM exposed")
def pii2_exposures(c: Catalog):
    return pii.exposures(found(c))


@query("pii2_exposure_breakdown", f"""
    WITH {_EXPOSED} SELECT s.severity, count(column_urn) AS columns, count(DISTINCT capsule_urn) AS capsules
    FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN exposed USING (severity) GROUP BY 1""")
def pii2_exposure_breakdown(c: Catalog):
    return pii.exposure_breakdown(pii.exposures(found(c)))


@query("pii3_columns_of_capsule", f"WITH {TAGGED_SQL} SELECT capsule_urn, urn AS column_urn, pii_type FROM found WHERE layer = 'gold'")
def pii3_columns_of_capsule(c: Catalog):
    rows = pii.pii_columns(tagged(c), c.view("v_capsules"), layer="gold")
    return rows.select("capsule_urn", F.col("urn").alias("column_urn"), "pii_type")


_NODE_SEEDS = f"seeds AS (SELECT urn AS seed FROM (SELECT urn, {PII_SQL} AS pii_type FROM v_column_nodes) WHERE pii_type IS NOT NULL)"
_ORIGIN_SQL = """parents AS (SELECT target_column_urn AS node, min(source_column_urn) AS parent FROM v_column_edges GROUP BY 1),
    walk AS (SELECT seed, seed AS node, [seed] AS trail FROM seeds
      UNION ALL SELECT seed, parent, list_append(trail, parent) FROM walk JOIN parents USING (node)
      WHERE NOT list_contains(trail, parent) AND len(trail) <= 10),
    origin AS (SELECT seed, arg_max(node, len(trail)) AS origin, max(len(trail)) - 1 AS hops FROM walk GROUP BY seed HAVING max(len(trail)) > 1)"""
_DOWN_SQL = """down AS (SELECT source_column_urn AS seed, target_column_urn AS node, 1 AS depth FROM v_column_edges WHERE source_column_urn IN (SELECT seed FROM seeds)
      UNION SELECT w.seed, e.target_column_urn, w.depth + 1 FROM down w JOIN v_column_edges e ON e.source_column_urn = w.node WHERE w.depth < 10),
    reach AS (SELECT seed, node, min(depth) AS depth FROM down WHERE seed <> node GROUP BY ALL),
    ends AS (SELECT seed, node, depth FROM reach WHERE depth < 10 AND node NOT IN (SELECT source_column_urn FROM v_column_edges))"""


def _pii_nodes(c: Catalog):
    return pii.tag_columns(c.view("v_column_nodes"))


def _pii_seeds(c: Catalog):
    return _pii_nodes(c).filter("pii_type is not null").select(F.col("urn").alias("seed"))


@query("g13_pii_origins", f"WITH {_NODE_SEEDS}, {_ORIGIN_SQL} SELECT seed, origin, hops FROM origin")
def g13_pii_origins(c: Catalog):
    return lineage.origins(c.view("v_column_edges"), _pii_seeds(c), 10, "source_column_urn", "target_column_urn")


@query("g14_pii_terminals", f"WITH {_NODE_SEEDS}, {_DOWN_SQL} SELECT seed, node, depth FROM ends")
def g14_pii_terminals(c: Catalog):
    edges = c.view("v_column_edges")
    reached = lineage.downstream(edges, _pii_seeds(c), 10, source="source_column_urn", target="target_column_urn")
    return lineage.terminals(edges, reached, 10, "source_column_urn")


@query("g15_pii_trace", f"""
    WITH {_NODE_SEEDS}, {_ORIGIN_SQL}, {_DOWN_SQL},
    d AS (SELECT seed, count(*) AS n FROM reach GROUP BY seed),
    t AS (SELECT seed, count(*) AS n, bool_and({_has('lower(name)', classify.MASKED_SUFFIX_PARTS)}) AS m FROM ends JOIN v_column_nodes ON urn = node GROUP BY seed)
    SELECT seed AS column_urn, origin, coalesce(hops, 0) AS upstream_hops, coalesce(d.n, 0) AS downstream_nodes, coalesce(t.n, 0) AS consumers,
      coalesce(t.m, false) AS masked_at_terminals
    FROM seeds LEFT JOIN origin USING (seed) LEFT JOIN d USING (seed) LEFT JOIN t USING (seed)""")
def g15_pii_trace(c: Catalog):
    return pii.trace(_pii_nodes(c), c.view("v_column_edges"))


def _scan_sql(key: str, table: str) -> str:
    counts = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {k}" for k, p in pii.CONTENT_PATTERNS.items())
    return f"SELECT {key}, {counts} FROM {table}"


@query("piit_documents", _scan_sql("doc_id", "documents"))
def piit_documents(c: Catalog):
    return pii.scan_text(c.table("documents"), "doc_id", "text")


@query("piit_conversations", _scan_sql("conv_id, turn", "conversations"))
def piit_conversations(c: Catalog):
    rows = c.table("conversations")
    return pii.scan_text(rows.withColumn("_id", F.struct("conv_id", "turn")), "_id", "text").select("_id.*", *pii.CONTENT_PATTERNS)
