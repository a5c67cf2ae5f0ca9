"""Property graph, export and source queries."""

from pyspark.sql import functions as F

from metaloom.functions.classify import transformation_of
from metaloom.operators import conformance as cf
from metaloom.operators import property_graph
from metaloom.plans import conformance_queries as cq
from metaloom.plans.pii_queries import PII_SQL, TAGGED_SQL, found, tagged
from metaloom.plans.registry import Catalog, query
from metaloom.sinks import export
from metaloom.sources import manifest, orchestrator, warehouse

# ------------------------------------------------------------------ graph

_NODES = f"""nodes AS (SELECT concat('urn:cat:domain:', n) AS urn, n AS name, 'domain' AS node_type, NULL AS layer, NULL AS domain FROM (SELECT DISTINCT domain AS n FROM v_capsules)
      UNION ALL SELECT urn, name, capsule_type, layer, domain FROM v_capsules UNION ALL SELECT urn, name, 'column', NULL, NULL FROM v_columns
      UNION ALL SELECT concat('urn:cat:tag:', tag), tag, 'tag', NULL, NULL FROM v_tags UNION ALL SELECT concat('urn:cat:product:', product), product, 'data_product', NULL, domain FROM v_data_products)"""
_EDGES = """edges AS (SELECT urn AS source_urn, concat('urn:cat:domain:', domain) AS target_urn, 'BELONGS_TO' AS edge_type FROM v_capsules WHERE domain IS NOT NULL
      UNION ALL SELECT source_urn, target_urn, upper(edge_type) FROM v_capsule_edges UNION ALL SELECT capsule_urn, urn, 'CONTAINS' FROM v_columns
      UNION ALL SELECT capsule_urn, concat('urn:cat:tag:', tag), 'TAGGED_WITH' FROM v_capsule_tags UNION ALL SELECT capsule_urn, concat('urn:cat:product:', product), 'PART_OF' FROM v_product_members)"""


def graph(c: Catalog):
    return property_graph.build({
        "domains": c.view("v_capsules").select("domain").distinct(), "capsules": c.view("v_capsules"), "edges": c.view("v_capsule_edges"), "columns": c.view("v_columns"),
        "tags": c.view("v_tags"), "capsule_tags": c.view("v_capsule_tags"), "products": c.view("v_data_products"), "product_members": c.view("v_product_members"),
    })


@query("g12_graph_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def g12_graph_nodes(c: Catalog):
    return graph(c)[0].drop("properties")


@query("g12_graph_edges", f"WITH {_EDGES} SELECT * FROM edges")
def g12_graph_edges(c: Catalog):
    return graph(c)[1]


@query("snk16_graphml_edges", f"""WITH {_EDGES} SELECT concat('    <edge id="e', substr(sha256(concat(source_urn, chr(1), target_urn, chr(1), edge_type)), 1, 24), '" source="', source_urn, '" target="', target_urn, '"><data key="edge_type">', edge_type, '</data></edge>') AS value FROM (SELECT DISTINCT * FROM edges)""")
def snk16_graphml_edges(c: Catalog):
    return export.graphml(*graph(c)).filter("part = 2").select("value")


@query("snk16_graphml_nodes", f"""WITH {_NODES} SELECT concat('    <node id="', urn, '"><data key="name">', name, '</data><data key="type">', node_type, '</data><data key="layer">', coalesce(layer, 'unknown'), '</data><data key="domain">', coalesce(domain, ''), '</data><data key="urn">', urn, '</data></node>') AS value FROM nodes""")
def snk16_graphml_nodes(c: Catalog):
    return export.graphml(*graph(c)).filter("part = 1").select("value")


@query("snk18_cypher", f"""WITH {_EDGES} SELECT concat('MATCH (a {{urn: "', source_urn, '"}}), (b {{urn: "', target_urn, '"}}) CREATE (a)-[:', edge_type, ']->(b);') AS value FROM edges""")
def snk18_cypher(c: Catalog):
    return export.cypher(*graph(c)).filter("part = 2").select("value")


@query("snk18_cypher_nodes", """
    WITH n AS (SELECT 'DOMAIN' AS label, concat('urn:cat:domain:', n) AS urn, n AS name, NULL AS layer, NULL AS domain, '' AS more FROM (SELECT DISTINCT domain AS n FROM v_capsules)
      UNION ALL SELECT upper(replace(replace(capsule_type, '-', '_'), ' ', '_')), urn, name, layer, domain, '' FROM v_capsules UNION ALL SELECT 'COLUMN', urn, name, NULL, NULL, concat(', data_type: "', data_type, '"') FROM v_columns
      UNION ALL SELECT 'TAG', concat('urn:cat:tag:', tag), tag, NULL, NULL, concat(', category: "', category, '", sensitivity_level: "', sensitivity_level, '"') FROM v_tags
      UNION ALL SELECT 'DATA_PRODUCT', concat('urn:cat:product:', product), product, NULL, domain, concat(', status: "', status, '"') FROM v_data_products)
    SELECT concat('CREATE (:', label, ' {urn: "', urn, '", name: "', name, '"', CASE WHEN coalesce(layer, '') <> '' THEN concat(', layer: "', layer, '"') ELSE '' END, CASE WHEN coalesce(domain, '') <> '' THEN concat(', domain: "', domain, '"') ELSE '' END, more, '});') AS value FROM n""")
def snk18_cypher_nodes(c: Catalog):
    return export.cypher(*graph(c)).filter("part = 1").select("value")


@query("snk20_jsonld", f"""WITH {_NODES}, {_EDGES}, r AS (SELECT DISTINCT source_urn AS urn, CASE edge_type WHEN 'FLOWS_TO' THEN 'flowsTo' WHEN 'BELONGS_TO' THEN 'belongsTo' WHEN 'TAGGED_WITH' THEN 'taggedWith' WHEN 'PART_OF' THEN 'partOf'
      WHEN 'CONTAINS' THEN 'contains' ELSE 'relatedTo' END AS relation, target_urn FROM edges WHERE source_urn IN (SELECT urn FROM nodes))
    SELECT urn, concat('{{"@id":"', urn, '","', relation, '":"', target_urn, '"}}') AS value FROM r""".replace("{{", "{").replace("}}", "}"))
def snk20_jsonld(c: Catalog):
    return export.jsonld(*graph(c)).filter("value not like '%\"nodeType\"%'")


@query("snk21_json_nodes", f"WITH {_NODES} SELECT urn, name, node_type AS type, layer, false AS has_pii FROM nodes")
def snk21_json_nodes(c: Catalog):
    return export.json_graph(*graph(c))[0]


@query("snk13_pii_report", f"WITH {TAGGED_SQL} SELECT pii_type, urn AS column_urn, name AS column_name, capsule_urn, capsule_name, coalesce(layer, '') AS layer, coalesce(data_type, '') AS data_type, 'pattern' AS detected_by FROM found")
def snk13_pii_report(c: Catalog):
    return export.pii_report(found(c))


@query("snk14_conformance_report", cq._violation_sql(["MED_001", "DBT_002", "DIM5_005"]) + "SELECT rule_id, subject_urn AS capsule_urn, subject_name AS capsule_name, concat('Table ''', subject_name, ''' violates ') AS opening FROM failed")
def snk14_conformance_report(c: Catalog):
    rows, rules = cq.evaluated(c, messages=True)
    report = export.conformance_report(cf.violations(rows, rules)).filter(F.col("rule_id").isin("MED_001", "DBT_002", "DIM5_005"))
    return report.select("rule_id", "capsule_urn", "capsule_name", F.regexp_extract("message", r"^(.*? violates )", 1).alias("opening"))


@query("snk15_capsule_report", f"""
    SELECT c.urn, c.name, capsule_type AS type, layer, database_name AS database, schema_name AS schema, coalesce(n, 0) AS column_count, coalesce(p, false) AS has_pii FROM v_capsules c
    LEFT JOIN (SELECT capsule_urn, count(*) AS n, bool_or({PII_SQL} IS NOT NULL) AS p FROM v_columns GROUP BY 1) k ON k.capsule_urn = c.urn WHERE layer = 'silver'""")
def snk15_capsule_report(c: Catalog):
    return export.capsule_report(c.view("v_capsules"), tagged(c), layer="silver")


@query("g12_derived_edges", f"WITH {_EDGES} SELECT * FROM edges WHERE edge_type <> 'CONTAINS' UNION ALL SELECT source_column_urn, target_column_urn, 'DERIVED_FROM' FROM v_column_edges")
def g12_derived_edges(c: Catalog):
    """The graph with column lineage instead of the tables' columns."""
    tables = {
        "domains": c.view("v_capsules").select("domain").distinct(), "capsules": c.view("v_capsules"), "edges": c.view("v_capsule_edges"), "column_edges": c.view("v_column_edges"),
        "tags": c.view("v_tags"), "capsule_tags": c.view("v_capsule_tags"), "products": c.view("v_data_products"), "product_members": c.view("v_product_members"),
    }
    return property_graph.build(tables)[1]


@query("set2_first_nodes", f"""
    WITH {_NODES}, every AS (SELECT urn, name, node_type, layer, domain FROM nodes UNION ALL SELECT urn, concat(name, '_a'), 'aaa', NULL, NULL FROM nodes WHERE layer = 'gold' UNION ALL SELECT urn, concat(name, '_z'), 'zzz', 'x', 'y' FROM nodes WHERE node_type = 'tag')
    SELECT urn, first.node_type AS node_type, first.name AS name FROM (SELECT urn, min(struct_pack(node_type := node_type, name := name)) AS first FROM every GROUP BY urn)""")
def set2_first_nodes(c: Catalog):
    """Nodes that several tables bring, one of each."""
    nodes, _ = graph(c)
    again = nodes.where("layer = 'gold'").withColumns({"name": F.concat("name", F.lit("_a")), "node_type": F.lit("aaa"), "layer": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    other = nodes.where("node_type = 'tag'").withColumns({"name": F.concat("name", F.lit("_z")), "node_type": F.lit("zzz"), "layer": F.lit("x"), "domain": F.lit("y")})
    return property_graph.first_of_each(nodes.unionByName(again).unionByName(other)).select("urn", "node_type", "name")


# ---------------------------------------------------------------- sources

_WH = "SELECT * FROM v_wh_tables WHERE schema_name <> 'INFORMATION_SCHEMA'"
_KIND = "CASE table_type WHEN 'VIEW' THEN 'view' WHEN 'MATERIALIZED VIEW' THEN 'materialized_view' WHEN 'EXTERNAL TABLE' THEN 'external_table' ELSE 'table' END"
_WH_CAPSULES = f"wc AS (SELECT concat('urn:cat:warehouse:', {_KIND}, ':', database_name, '.', schema_name, ':', table_name) AS urn, table_name AS name, {_KIND} AS capsule_type, concat_ws('.', database_name, schema_name, table_name) AS unique_id, database_name, schema_name, CASE schema_name WHEN 'RAW_SALES' THEN 'bronze' WHEN 'STAGING' THEN 'silver' WHEN 'MARTS' THEN 'gold' END AS layer FROM ({_WH}))"


def wh_capsules(c: Catalog):
    return warehouse.capsules(warehouse.tables(c.view("v_wh_tables")))


@query("src6_warehouse_tables", _WH)
def src6_warehouse_tables(c: Catalog):
    return warehouse.tables(c.view("v_wh_tables"))


@query("src8_warehouse_capsules", f"WITH {_WH_CAPSULES} SELECT * FROM wc")
def src8_warehouse_capsules(c: Catalog):
    return wh_capsules(c)


_WH_COLUMNS = """wcol AS (SELECT concat('urn:cat:warehouse:column:', k.database_name, '.', k.schema_name, ':', k.table_name, '.', k.column_name) AS urn, w.urn AS capsule_urn, k.column_name AS name,
      CASE k.data_type WHEN 'VARCHAR(16)' THEN 'STRING' WHEN 'TEXT' THEN 'STRING' WHEN 'NUMBER(38,0)' THEN 'INTEGER' WHEN 'NUMBER(10,2)' THEN 'DECIMAL' WHEN 'VARIANT' THEN 'JSON' WHEN 'OBJECT' THEN 'STRUCT' ELSE 'TIMESTAMP_TZ' END AS data_type, is_nullable = 'YES' AS is_nullable
      FROM v_wh_columns k JOIN wc w ON w.database_name = k.database_name AND w.schema_name = k.schema_name AND w.name = k.table_name)"""


def wh_columns(c: Catalog):
    return warehouse.catalog_columns(warehouse.columns(c.view("v_wh_columns")), wh_capsules(c))


@query("src7_warehouse_columns", f"WITH {_WH_CAPSULES}, {_WH_COLUMNS} SELECT * FROM wcol")
def src7_warehouse_columns(c: Catalog):
    return wh_columns(c)


@query("src11_tagged_columns", f"""
    WITH {_WH_CAPSULES}, {_WH_COLUMNS} SELECT urn, name, CASE WHEN name = 'AMOUNT' THEN NULL ELSE 'pii' END AS semantic_type,
      CASE name WHEN 'EMAIL' THEN 'email' WHEN 'PHONE_NO' THEN 'phone' WHEN 'CITY' THEN 'address' WHEN 'SSN' THEN 'confidential' WHEN 'USERNAME' THEN 'name' WHEN 'IP_ADDR' THEN 'ip_address' END AS pii_type,
      CASE WHEN name IN ('PHONE_NO', 'SSN', 'IP_ADDR') THEN 'snowflake_tag' WHEN name = 'AMOUNT' THEN NULL ELSE 'snowflake_tag_inferred' END AS pii_detected_by FROM wcol""")
def src11_tagged_columns(c: Catalog):
    return warehouse.apply_tags(wh_columns(c), c.view("v_wh_tags")).select("urn", "name", "semantic_type", "pii_type", "pii_detected_by")


@query("src9_access_lineage", f"""
    WITH {_WH_CAPSULES}, log AS (SELECT l_orderkey AS query_id, l_shipdate AS ts, concat('PROD.RAW_SALES.T', CAST(l_partkey AS STRING)) AS s, concat('PROD.MARTS.T', CAST(l_suppkey AS STRING)) AS t, l_returnflag AS f FROM lineitem)
    SELECT a.urn AS source_urn, b.urn AS target_urn, 'flows_to' AS edge_type, 'query' AS transformation, count(DISTINCT query_id) AS query_count, max(ts) AS last_query_time
    FROM log JOIN wc a ON a.unique_id = s JOIN wc b ON b.unique_id = t WHERE f <> 'N' AND ts >= TIMESTAMP '2001-09-01 00:00:00' - INTERVAL 365 DAY GROUP BY 1, 2""")
def src9_access_lineage(c: Catalog):
    thing = lambda schema, key, kind: F.array(F.struct(F.concat(F.lit(f"PROD.{schema}.T"), F.col(key).cast("string")).alias("objectName"), F.lit(kind).alias("objectDomain")))
    modified = F.when(F.col("l_returnflag") != "N", thing("MARTS", "l_suppkey", "Table")).otherwise(thing("MARTS", "l_suppkey", "Stage"))
    log = c.table("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_shipdate").alias("query_start_time"), thing("RAW_SALES", "l_partkey", "View").alias("base_objects_accessed"), modified.alias("objects_modified"))
    return warehouse.access_lineage(log, wh_capsules(c), "2001-09-01 00:00:00", 365)


@query("src10_view_lineage", f"""
    WITH {_WH_CAPSULES}, v AS (SELECT w.urn, substr(w.name, 2) AS k FROM wc w WHERE capsule_type = 'view')
    SELECT a.urn AS source_urn, v.urn AS target_urn, 'flows_to' AS edge_type, 'view_definition' AS transformation FROM v JOIN wc a ON a.unique_id IN (concat('PROD.RAW_SALES.T', k), concat('PROD.MARTS.T', k))""")
def src10_view_lineage(c: Catalog):
    views = wh_capsules(c).filter("capsule_type = 'view'")
    text = F.concat(F.lit("CREATE VIEW x AS SELECT * -- FROM t0\nFROM raw_sales.\""), "name", F.lit("\" a /* JOIN t1 */\n  LEFT JOIN prod.marts."), F.lower("name"), F.lit(" b ON a.id = b.id"))
    ddl = views.select("database_name", "schema_name", F.col("name").alias("view_name"), text.alias("ddl"))
    return warehouse.view_lineage(ddl, wh_capsules(c))


@query("src20_task_sql_edges", f"""
    WITH {_WH_CAPSULES}, t AS (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey FROM lineitem)
    SELECT concat('urn:cat:task:', l_suppkey, '.', l_linenumber) AS task_urn, urn AS capsule_urn, 'consumes' AS edge_type FROM t JOIN wc ON unique_id = concat('PROD.RAW_SALES.T', l_partkey)
    UNION SELECT concat('urn:cat:task:', l_suppkey, '.', l_linenumber), urn, 'produces' FROM t JOIN wc ON unique_id = concat('PROD.MARTS.T', l_suppkey)""")
def src20_task_sql_edges(c: Catalog):
    s = lambda k: F.col(k).cast("string")
    task = F.concat(F.lit("urn:cat:task:"), s("l_suppkey"), F.lit("."), s("l_linenumber"))
    sql = F.concat(F.lit("insert into marts.t"), s("l_suppkey"), F.lit(" select * from raw_sales.t"), s("l_partkey"), F.lit(" where 1 = 1"))
    return warehouse.task_sql_edges(c.table("lineitem").select(task.alias("task_urn"), sql.alias("sql")).distinct(), wh_capsules(c), "prod")


@query("src22_unknown_references", "SELECT DISTINCT task_urn, capsule_urn FROM v_order_task_edges WHERE capsule_urn NOT IN (SELECT urn FROM v_capsules) AND edge_type = 'produces'")
def src22_unknown_references(c: Catalog):
    annotated = c.view("v_order_task_edges").filter("edge_type = 'produces'")
    return orchestrator.unknown_references(annotated, c.view("v_capsules")).distinct()


@query("src21_first_source_wins", """
    WITH a AS (SELECT DISTINCT task_urn, capsule_urn, edge_type, 1 AS p FROM v_task_edges WHERE edge_type = 'produces' UNION SELECT task_urn, capsule_urn, edge_type, 2 FROM v_task_edges WHERE edge_type = 'consumes'
      UNION SELECT task_urn, capsule_urn, edge_type, 3 FROM v_task_edges)
    SELECT task_urn, capsule_urn, edge_type FROM (SELECT *, min(p) OVER (PARTITION BY task_urn) AS m FROM a) WHERE p = m""")
def src21_first_source_wins(c: Catalog):
    rows = c.view("v_task_edges")
    return orchestrator.first_source_wins(rows.filter("edge_type = 'produces'"), rows.filter("edge_type = 'consumes'"), rows)


def nodes(c: Catalog):
    """Parts as manifest nodes: each depends on the part of its size."""
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_type") == "STANDARD", "source").when(F.col("p_type") == "PROMO", "seed").otherwise("model")
    empty = lambda t: F.lit(None).cast(t)
    column = F.struct(F.lit("email").alias("name"), empty("string").alias("description"), F.create_map(F.lit("pii"), F.lit("true")).alias("meta"), F.array(F.lit("pii:email")).alias("tags"), F.array(F.lit("unique")).alias("data_tests"), empty("array<string>").alias("depends_on"))
    return c.table("part").select(
        F.lit("shop").alias("project"), F.concat(kind, F.lit(".shop.p"), key).alias("unique_id"), kind.alias("resource_type"), F.concat(F.when(F.col("p_size") % 2 == 0, "stg_p").otherwise("p"), key).alias("name"),
        F.lower("p_type").alias("schema_name"), F.lower("p_type").alias("namespace"), F.lit("db").alias("database_name"), F.lit("shop").alias("package_name"), F.concat(F.lit("models/"), F.lower("p_type"), F.lit("/"), key, F.lit(".sql")).alias("path"),
        F.col("p_name").alias("description"), F.array("p_brand", F.concat(F.lit("domain:"), size)).alias("tags"), empty("map<string,string>").alias("meta"), F.lit("table").alias("materialization"),
        F.array(F.concat(F.lit("model.shop.p"), size), F.concat(F.lit("source.shop.p"), size)).alias("depends_on"), empty("map<string,array<string>>").alias("depends_on_columns"),
        F.create_map(F.lit("Email"), column).alias("columns"), empty("array<string>").alias("data_tests"), empty("string").alias("catalog_col_lineage"),
    ).withColumn("data_tests", F.coalesce("data_tests", F.array().cast("array<string>")))


_NODE_SQL = """n AS (SELECT CASE p_type WHEN 'STANDARD' THEN 'source' WHEN 'PROMO' THEN 'seed' ELSE 'model' END AS kind, p_partkey AS k, p_size, p_type, p_brand, concat(CASE WHEN p_size % 2 = 0 THEN 'stg_p' ELSE 'p' END, p_partkey) AS name FROM part),
    c AS (SELECT *, concat(kind, '.shop.p', k) AS unique_id, concat('urn:cat:dbt:', kind, ':shop.', lower(p_type), ':', name) AS urn FROM n)"""


@query("src1_manifest_capsules", f"WITH {_NODE_SQL} SELECT urn, name, kind AS capsule_type, CASE WHEN kind IN ('seed', 'source') THEN 'bronze' WHEN p_size % 2 = 0 THEN 'silver' END AS layer, CAST(p_size AS STRING) AS domain, 1 AS test_count FROM c")
def src1_manifest_capsules(c: Catalog):
    return manifest.capsules(nodes(c)).select("urn", "name", "capsule_type", "layer", "domain", "test_count")


@query("src2_manifest_columns", f"WITH {_NODE_SQL} SELECT concat(urn, '.Email') AS urn, urn AS capsule_urn, 'unknown' AS pii_type, 'tag' AS pii_detected_by, 'pii' AS semantic_type FROM c")
def src2_manifest_columns(c: Catalog):
    return manifest.columns(nodes(c)).select("urn", "capsule_urn", "pii_type", "pii_detected_by", "semantic_type")


@query("src3_manifest_edges", f"WITH {_NODE_SQL} SELECT s.urn AS source_urn, t.urn AS target_urn, 'flows_to' AS edge_type, CASE s.kind WHEN 'source' THEN 'source' ELSE 'ref' END AS transformation FROM c t JOIN c s ON s.k = t.p_size AND s.kind IN ('model', 'source')")
def src3_manifest_edges(c: Catalog):
    return manifest.edges(nodes(c))


@query("src5_manifest_tags", f"WITH {_NODE_SQL} SELECT DISTINCT p_brand AS name, NULL AS category FROM c UNION ALL SELECT DISTINCT concat('domain:', p_size), 'domain' FROM c UNION ALL SELECT DISTINCT 'pii:email', 'sensitivity' FROM c")
def src5_manifest_tags(c: Catalog):
    rows = nodes(c)
    return manifest.tags(manifest.capsules(rows), manifest.columns(rows))


@query("j9_selectors", f"WITH {_NODE_SQL} SELECT DISTINCT concat('tag:', p_brand) AS selector, unique_id FROM c WHERE kind = 'model' UNION ALL SELECT name, unique_id FROM c WHERE kind = 'model' UNION ALL SELECT concat('shop.', name), unique_id FROM c WHERE kind = 'model'")
def j9_selectors(c: Catalog):
    rows = nodes(c)
    wanted = rows.select(F.explode(F.array(F.concat(F.lit("tag:"), F.col("tags")[0]), F.col("name"), F.concat(F.lit("shop."), "name"))).alias("selector")).distinct()
    return manifest.select_models(wanted, rows)


@query("f21_transformations", """
    SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS st, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'identity' WHEN '2' THEN 'cast' WHEN '3' THEN 'aggregate' WHEN '4' THEN 'arithmetic' ELSE 'conditional' END AS kind,
      round(CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.95 WHEN '3' THEN 0.95 WHEN '4' THEN 0.9 ELSE 0.85 END * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.95 ELSE 0.9 END AS DOUBLE), 6) AS confidence FROM orders""")
def f21_transformations(c: Catalog):
    p, st = F.substr("o_orderpriority", F.lit(1), F.lit(1)), F.col("o_orderstatus")
    text = F.when(p == "1", "o.total").when(p == "2", "CAST(total AS int)").when(p == "3", "sum(total - tax)").when(p == "4", "total * (1 - tax)").otherwise("case when a - b > 0 then 1 else 0 end")
    m = transformation_of(text, F.when(st == "F", "select").when(st == "O", "insert").otherwise("update"))
    rows = c.table("orders").select(F.col("o_orderpriority").alias("p"), st.alias("st"), m.alias("m")).distinct()
    return rows.select("p", "st", F.col("m.transformation_type").alias("kind"), F.round("m.confidence", 6).alias("confidence"))


@query("src23_column_mappings", """
    SELECT concat('task:', k.variant) AS task_urn, k.urn AS source_column_urn, k2.urn AS target_column_urn, 'string_transform' AS transformation_type FROM v_columns k JOIN v_columns k2 ON k2.capsule_urn = k.capsule_urn AND k2.name = replace(k.name, 'email_', 'ssn_') WHERE k.name LIKE 'email\\_%' ESCAPE '\\'""")
def src23_column_mappings(c: Catalog):
    capsules = c.view("v_capsules")
    rows = c.view("v_columns").filter(F.col("name").startswith("email_")).join(capsules.select(F.col("urn").alias("capsule_urn"), F.col("name").alias("t")), "capsule_urn")
    mapped = rows.select(
        F.concat(F.lit("task:"), F.col("variant").cast("string")).alias("task_urn"), F.concat_ws(".", "t", F.replace("name", F.lit("email_"), F.lit("ssn_"))).alias("target_column"),
        F.concat(F.lit("upper("), "name", F.lit(")")).alias("expression"), F.array(F.concat_ws(".", "t", "name")).alias("source_columns"), F.lit("select").alias("statement"))
    return orchestrator.column_mappings(mapped, capsules, c.view("v_columns")).select("task_urn", "source_column_urn", "target_column_urn", "transformation_type")
