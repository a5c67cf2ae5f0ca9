"""Lineage and graph queries."""

from pyspark.sql import functions as F

from metaloom.operators import label_index, lineage
from metaloom.plans.registry import Catalog, query

DEPTH = 4


def reach_sql(edges: str, depth: int, start: str, end: str, seeds: str = "") -> str:
    """Recursive SQL for (seed, node, least depth) without the seed itself."""
    base = f"SELECT {start} AS seed, {end} AS node, 1 AS depth FROM {edges}"
    if seeds:
        base += f" WHERE {start} IN (SELECT seed FROM {seeds})"
    return f"""
        WITH walk AS ({base} UNION SELECT w.seed, e.{end}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{start} = w.node WHERE w.depth < {depth}),
        reach AS (SELECT seed, node, min(depth) AS depth FROM walk WHERE seed <> node GROUP BY seed, node)"""


@query("g1_upstream", reach_sql("v_edges", DEPTH, "target_urn", "source_urn") + " SELECT * FROM reach")
def g1_upstream(c: Catalog):
    return lineage.upstream(c.view("v_edges"), max_depth=DEPTH)


@query("g2_downstream", reach_sql("v_edges", DEPTH, "source_urn", "target_urn") + " SELECT * FROM reach")
def g2_downstream(c: Catalog):
    return lineage.downstream(c.view("v_edges"), max_depth=DEPTH)


@query("g1_upstream_cyclic", reach_sql("v_users", 3, "target_urn", "source_urn") + " SELECT * FROM reach")
def g1_upstream_cyclic(c: Catalog):
    return lineage.upstream(c.view("v_users"), max_depth=3)


@query("g2_downstream_cyclic", reach_sql("v_edges_cyclic", 5, "source_urn", "target_urn", "v_nation_seeds") + " SELECT * FROM reach")
def g2_downstream_cyclic(c: Catalog):
    return lineage.downstream(c.view("v_edges_cyclic"), c.view("v_nation_seeds"), max_depth=5)


_ATTRS = ["edge_type", "transformation_type", "transformation_logic", "confidence", "detected_by"]


def _all_depths_sql(start: str, end: str) -> str:
    attrs = ", ".join(_ATTRS)
    return f"""
        WITH walk AS (
          SELECT {start} AS seed, {end} AS node, {attrs}, 1 AS depth FROM v_column_edges
          UNION SELECT w.seed, e.{end}, {', '.join('e.' + a for a in _ATTRS)}, w.depth + 1
          FROM walk w JOIN v_column_edges e ON e.{start} = w.node WHERE w.depth < 3)
        SELECT w.*, n.name AS column_name, n.data_type, n.capsule_urn FROM walk w JOIN v_column_nodes n ON n.urn = w.node"""


def _described(c: Catalog, reached):
    nodes = c.view("v_column_nodes").select(
        F.col("urn").alias("node"), F.col("name").alias("column_name"), "data_type", "capsule_urn"
    )
    return reached.join(nodes, "node")


_COLUMN_ENDS = {"source": "source_column_urn", "target": "target_column_urn"}


@query("g3_upstream_columns", _all_depths_sql("target_column_urn", "source_column_urn"))
def g3_upstream_columns(c: Catalog):
    return _described(c, lineage.upstream(c.view("v_column_edges"), max_depth=3, mode="all_depths", attributes=_ATTRS, **_COLUMN_ENDS))


@query("g4_downstream_columns", _all_depths_sql("source_column_urn", "target_column_urn"))
def g4_downstream_columns(c: Catalog):
    return _described(c, lineage.downstream(c.view("v_column_edges"), max_depth=3, mode="all_depths", attributes=_ATTRS, **_COLUMN_ENDS))


@query("g5_trace_columns", """
    WITH seeds AS (SELECT urn AS seed FROM v_column_nodes),
    e AS (SELECT DISTINCT source_column_urn AS s, target_column_urn AS t FROM v_column_edges),
    dwalk AS (SELECT s AS seed, t AS node, 1 AS depth FROM e UNION SELECT w.seed, e.t, w.depth + 1 FROM dwalk w JOIN e ON e.s = w.node WHERE w.depth < 5),
    uwalk AS (SELECT t AS seed, s AS node, 1 AS depth FROM e UNION SELECT w.seed, e.s, w.depth + 1 FROM uwalk w JOIN e ON e.t = w.node WHERE w.depth < 5),
    d AS (SELECT seed, node, min(depth) AS depth FROM dwalk WHERE seed <> node GROUP BY ALL),
    u AS (SELECT seed, node, min(depth) AS depth FROM uwalk WHERE seed <> node GROUP BY ALL),
    dn AS (SELECT seed, count(*) AS nodes, max(depth) AS max_depth FROM d GROUP BY seed),
    un AS (SELECT seed, count(*) AS nodes, max(depth) AS max_depth FROM u GROUP BY seed),
    de AS (SELECT p.seed, count(*) AS edges FROM (SELECT seed, node FROM d WHERE depth < 5 UNION SELECT seed, seed FROM seeds) p JOIN e ON e.s = p.node GROUP BY p.seed),
    ue AS (SELECT p.seed, count(*) AS edges FROM (SELECT seed, node FROM u WHERE depth < 5 UNION SELECT seed, seed FROM seeds) p JOIN e ON e.t = p.node GROUP BY p.seed)
    SELECT seed, nodes, max_depth, edges, 'downstream' AS direction FROM dn LEFT JOIN de USING (seed)
    UNION ALL SELECT seed, nodes, max_depth, edges, 'upstream' FROM un LEFT JOIN ue USING (seed)""")
def g5_trace_columns(c: Catalog):
    seeds = c.view("v_column_nodes").select(F.col("urn").alias("seed"))
    return lineage.trace_columns(c.view("v_column_edges"), seeds, max_depth=5)


@query("g6_column_lineage_depth", reach_sql("v_column_edges", 10, "source_column_urn", "target_column_urn")
       + " SELECT seed, max(depth) AS actual_depth, count(*) AS nodes FROM reach GROUP BY seed")
def g6_column_lineage_depth(c: Catalog):
    reached = lineage.downstream(c.view("v_column_edges"), max_depth=10, **_COLUMN_ENDS)
    return reached.groupBy("seed").agg(F.max("depth").alias("actual_depth"), F.count("*").alias("nodes"))


@query("g7_transformations", """
    SELECT target_column_urn, source_column_urn, transformation_type, transformation_logic, confidence
    FROM v_column_edges WHERE transformation_logic IS NOT NULL""")
def g7_transformations(c: Catalog):
    return lineage.transformations_into(c.view("v_column_edges"))


@query("g8_direct_edges", """
    SELECT urn, CAST(sum(i) AS BIGINT) AS producers, CAST(sum(o) AS BIGINT) AS consumers FROM (
      SELECT source_urn AS urn, 0 AS i, 1 AS o FROM v_edges UNION ALL SELECT target_urn, 1, 0 FROM v_edges) GROUP BY urn""")
def g8_direct_edges(c: Catalog):
    return lineage.degrees(c.view("v_edges"))


@query("g9_integrated_lineage", """
    WITH seeds AS (SELECT urn AS seed FROM v_capsules WHERE layer = 'gold'),
    dwalk AS (SELECT source_urn AS seed, target_urn AS node, 1 AS depth FROM v_capsule_edges WHERE source_urn IN (SELECT seed FROM seeds)
      UNION SELECT w.seed, e.target_urn, w.depth + 1 FROM dwalk w JOIN v_capsule_edges e ON e.source_urn = w.node WHERE w.depth < 2),
    uwalk AS (SELECT target_urn AS seed, source_urn AS node, 1 AS depth FROM v_capsule_edges WHERE target_urn IN (SELECT seed FROM seeds)
      UNION SELECT w.seed, e.source_urn, w.depth + 1 FROM uwalk w JOIN v_capsule_edges e ON e.target_urn = w.node WHERE w.depth < 2),
    found AS (SELECT seed, seed AS urn, 0 AS r FROM seeds UNION ALL SELECT seed, node, 1 FROM uwalk WHERE seed <> node
      UNION ALL SELECT seed, node, 2 FROM dwalk WHERE seed <> node
      UNION ALL SELECT capsule_urn, task_urn, CASE edge_type WHEN 'produces' THEN 3 ELSE 4 END FROM v_task_edges
        WHERE edge_type IN ('produces', 'consumes') AND capsule_urn IN (SELECT seed FROM seeds)),
    nodes AS (SELECT seed, urn, min(r) AS r FROM found GROUP BY seed, urn)
    SELECT seed, count(*) AS total_nodes, count(*) FILTER (r < 3) AS capsules, count(*) FILTER (r > 2) AS tasks,
      count(*) FILTER (r = 1) AS upstream, count(*) FILTER (r = 2) AS downstream FROM nodes GROUP BY seed""")
def g9_integrated_lineage(c: Catalog):
    seeds = c.view("v_capsules").filter("layer = 'gold'").select(F.col("urn").alias("seed"))
    return lineage.integrated_lineage(c.view("v_capsule_edges"), c.view("v_task_edges"), seeds, max_depth=2)[1]


@query("g10_capsule_lineage", """
    WITH dwalk AS (SELECT source_urn AS seed, target_urn AS node, 1 AS depth FROM v_edges
      UNION SELECT w.seed, e.target_urn, w.depth + 1 FROM dwalk w JOIN v_edges e ON e.source_urn = w.node WHERE w.depth < 4),
    pairs AS (SELECT seed, node, min(depth) AS depth FROM dwalk WHERE seed <> node GROUP BY seed, node)
    SELECT seed, 'downstream' AS direction, count(*) AS nodes, max(depth) AS max_depth FROM pairs GROUP BY seed
    UNION ALL SELECT node, 'upstream', count(*), max(depth) FROM pairs GROUP BY node""")
def g10_capsule_lineage(c: Catalog):
    return lineage.lineage_counts(c.view("v_edges"), max_depth=DEPTH)


@query("g11_subgraph_edges", reach_sql("v_edges_cyclic", 2, "source_urn", "target_urn", "v_nation_seeds") + """
    SELECT DISTINCT p.seed, e.source_urn, e.target_urn
    FROM (SELECT seed, node FROM reach WHERE depth < 2 UNION SELECT seed, seed FROM v_nation_seeds) p JOIN v_edges_cyclic e ON e.source_urn = p.node""")
def g11_subgraph_edges(c: Catalog):
    edges, seeds = c.view("v_edges_cyclic"), c.view("v_nation_seeds")
    reached = lineage.downstream(edges, seeds, max_depth=2)
    return lineage.walked_edges(edges, reached, seeds, max_depth=2).select("seed", "source_urn", "target_urn")


@query("g16_task_order", """
    SELECT o.pipeline_urn, source_task_urn, target_task_urn FROM v_task_order o
    JOIN v_workflows w ON w.urn = o.pipeline_urn WHERE w.is_active AND NOT w.is_paused""")
def g16_task_order(c: Catalog):
    running = c.view("v_workflows").filter("is_active and not is_paused").select(F.col("urn").alias("pipeline_urn"))
    return lineage.task_order(c.view("v_task_order"), running)


@query("j10_edges_touching", """
    SELECT DISTINCT source_urn, target_urn, edge_type FROM v_capsule_edges
    WHERE source_urn IN (SELECT urn FROM v_capsules WHERE layer = 'gold') OR target_urn IN (SELECT urn FROM v_capsules WHERE layer = 'gold')""")
def j10_edges_touching(c: Catalog):
    return lineage.direct_edges(c.view("v_capsule_edges"), c.view("v_capsules").filter("layer = 'gold'"))


@query("tk4_lineage_order", reach_sql("v_column_edges", 3, "source_column_urn", "target_column_urn") + """
    SELECT seed, node, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS position FROM reach""")
def tk4_lineage_order(c: Catalog):
    from pyspark.sql import Window as W

    reached = lineage.downstream(c.view("v_column_edges"), max_depth=3, **_COLUMN_ENDS)
    return reached.withColumn("position", F.row_number().over(W.partitionBy("seed").orderBy("depth", "node")))


# ------------------------------------------------- seed tables through the label index

_BRONZE = "bronze AS (SELECT urn AS seed FROM v_column_nodes WHERE layer = 'bronze')"


def _bronze(c: Catalog):
    """The columns where personal data enters."""
    return c.view("v_column_nodes").filter("layer = 'bronze'").select(F.col("urn").alias("seed"))


def _with_bronze(sql: str) -> str:
    return sql.strip().replace("WITH ", f"WITH {_BRONZE}, ", 1)


@query("g1_upstream_indexed", reach_sql("v_edges_cyclic", 4, "target_urn", "source_urn", "v_nation_seeds") + " SELECT * FROM reach")
def g1_upstream_indexed(c: Catalog):
    return label_index.reachable(label_index.build(c.view("v_edges_cyclic"), 4), c.view("v_nation_seeds"), "upstream")


@query("g2_downstream_indexed", reach_sql("v_edges_cyclic", 5, "source_urn", "target_urn", "v_nation_seeds") + " SELECT * FROM reach")
def g2_downstream_indexed(c: Catalog):
    return label_index.reachable(label_index.build(c.view("v_edges_cyclic"), 5), c.view("v_nation_seeds"))


@query("g4_downstream_columns_indexed", _with_bronze(reach_sql("v_column_edges", 3, "source_column_urn", "target_column_urn", "bronze"))
       + " SELECT r.*, n.name AS column_name, n.data_type, n.capsule_urn FROM reach r JOIN v_column_nodes n ON n.urn = r.node")
def g4_downstream_columns_indexed(c: Catalog):
    index = label_index.build(c.view("v_column_edges"), 3, **_COLUMN_ENDS)
    return _described(c, label_index.reachable(index, _bronze(c)))


@query("g3_upstream_columns_indexed", _with_bronze(reach_sql("v_column_edges", 3, "target_column_urn", "source_column_urn").replace("WITH ", "WITH marts AS (SELECT urn AS seed FROM v_column_nodes WHERE layer = 'marts'), ", 1).replace("SELECT target_column_urn AS seed, source_column_urn AS node, 1 AS depth FROM v_column_edges", "SELECT target_column_urn AS seed, source_column_urn AS node, 1 AS depth FROM v_column_edges WHERE target_column_urn IN (SELECT seed FROM marts)"))
       + " SELECT r.*, n.name AS column_name, n.data_type, n.capsule_urn FROM reach r JOIN v_column_nodes n ON n.urn = r.node")
def g3_upstream_columns_indexed(c: Catalog):
    seeds = c.view("v_column_nodes").filter("layer = 'marts'").select(F.col("urn").alias("seed"))
    index = label_index.build(c.view("v_column_edges"), 3, **_COLUMN_ENDS)
    return _described(c, label_index.reachable(index, seeds, "upstream"))


@query("g5_trace_columns_indexed", _with_bronze("""
    WITH e AS (SELECT DISTINCT source_column_urn AS s, target_column_urn AS t FROM v_column_edges),
    walk AS (SELECT s AS seed, t AS node, 1 AS depth FROM e WHERE s IN (SELECT seed FROM bronze) UNION SELECT w.seed, e.t, w.depth + 1 FROM walk w JOIN e ON e.s = w.node WHERE w.depth < 5),
    d AS (SELECT seed, node, min(depth) AS depth FROM walk WHERE seed <> node GROUP BY ALL),
    n AS (SELECT seed, count(*) AS nodes, max(depth) AS max_depth FROM d GROUP BY seed),
    k AS (SELECT p.seed, count(*) AS edges FROM (SELECT seed, node FROM d WHERE depth < 5 UNION SELECT seed, seed FROM bronze) p JOIN e ON e.s = p.node GROUP BY p.seed)
    SELECT seed, nodes, max_depth, edges, 'downstream' AS direction FROM n JOIN k USING (seed)"""))
def g5_trace_columns_indexed(c: Catalog):
    edges = c.view("v_column_edges").select("source_column_urn", "target_column_urn").distinct()
    return lineage.trace_columns(edges, _bronze(c), max_depth=5, index=label_index.build(edges, 5, **_COLUMN_ENDS))


@query("g6_column_depth_indexed", _with_bronze(reach_sql("v_column_edges", 10, "source_column_urn", "target_column_urn", "bronze"))
       + " SELECT seed, max(depth) AS actual_depth, count(*) AS nodes FROM reach GROUP BY seed")
def g6_column_depth_indexed(c: Catalog):
    reached = label_index.reachable(label_index.build(c.view("v_column_edges"), 10, **_COLUMN_ENDS), _bronze(c))
    return reached.groupBy("seed").agg(F.max("depth").alias("actual_depth"), F.count("*").alias("nodes"))


@query("g10_counts_indexed", """
    WITH dwalk AS (SELECT source_urn AS seed, target_urn AS node, 1 AS depth FROM v_edges_cyclic WHERE source_urn IN (SELECT seed FROM v_nation_seeds)
      UNION SELECT w.seed, e.target_urn, w.depth + 1 FROM dwalk w JOIN v_edges_cyclic e ON e.source_urn = w.node WHERE w.depth < 4),
    uwalk AS (SELECT target_urn AS seed, source_urn AS node, 1 AS depth FROM v_edges_cyclic WHERE target_urn IN (SELECT seed FROM v_nation_seeds)
      UNION SELECT w.seed, e.source_urn, w.depth + 1 FROM uwalk w JOIN v_edges_cyclic e ON e.target_urn = w.node WHERE w.depth < 4),
    pairs AS (SELECT seed, node, min(depth) AS depth, 'downstream' AS direction FROM dwalk WHERE seed <> node GROUP BY 1, 2 UNION ALL SELECT seed, node, min(depth), 'upstream' FROM uwalk WHERE seed <> node GROUP BY 1, 2)
    SELECT seed, direction, count(*) AS nodes, max(depth) AS max_depth FROM pairs GROUP BY 1, 2""")
def g10_counts_indexed(c: Catalog):
    return label_index.reach_counts(label_index.build(c.view("v_edges_cyclic"), 4), c.view("v_nation_seeds"))


@query("g2_distances_indexed", reach_sql("v_edges_cyclic", 4, "source_urn", "target_urn", "v_nation_seeds") + """
    SELECT n.seed AS source, concat('supplier:', CAST(s_suppkey AS STRING)) AS target, r.depth FROM v_nation_seeds n JOIN supplier ON true
    LEFT JOIN reach r ON r.seed = n.seed AND r.node = concat('supplier:', CAST(s_suppkey AS STRING)) WHERE n.seed = concat('nation:', CAST((s_suppkey % 25) AS STRING))""")
def g2_distances_indexed(c: Catalog):
    asked = c.table("supplier").select(F.concat(F.lit("nation:"), (F.col("s_suppkey") % 25).cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("target"))
    return label_index.distances(label_index.build(c.view("v_edges_cyclic"), 4), asked)


@query("g11_subgraph_both_ways", """
    WITH dwalk AS (SELECT source_urn AS seed, target_urn AS node, 1 AS depth FROM v_edges_cyclic WHERE source_urn IN (SELECT seed FROM v_nation_seeds)
      UNION SELECT w.seed, e.target_urn, w.depth + 1 FROM dwalk w JOIN v_edges_cyclic e ON e.source_urn = w.node WHERE w.depth < 2),
    uwalk AS (SELECT target_urn AS seed, source_urn AS node, 1 AS depth FROM v_edges_cyclic WHERE target_urn IN (SELECT seed FROM v_nation_seeds)
      UNION SELECT w.seed, e.source_urn, w.depth + 1 FROM uwalk w JOIN v_edges_cyclic e ON e.target_urn = w.node WHERE w.depth < 2)
    SELECT DISTINCT p.seed, e.source_urn, e.target_urn, 'downstream' AS direction FROM (SELECT seed, node FROM dwalk WHERE depth < 2 UNION SELECT seed, seed FROM v_nation_seeds) p JOIN v_edges_cyclic e ON e.source_urn = p.node
    UNION SELECT DISTINCT p.seed, e.source_urn, e.target_urn, 'upstream' FROM (SELECT seed, node FROM uwalk WHERE depth < 2 UNION SELECT seed, seed FROM v_nation_seeds) p JOIN v_edges_cyclic e ON e.target_urn = p.node""")
def g11_subgraph_both_ways(c: Catalog):
    return lineage.subgraph(c.view("v_edges_cyclic"), c.view("v_nation_seeds"), max_depth=2).select("seed", "source_urn", "target_urn", "direction")


@query("g8_edge_rows", """
    WITH seeds AS (SELECT urn FROM v_column_nodes WHERE layer = 'silver')
    SELECT source_column_urn, target_column_urn, transformation_type, 'consumer' AS role, source_column_urn AS urn FROM v_column_edges WHERE source_column_urn IN (SELECT urn FROM seeds)
    UNION SELECT source_column_urn, target_column_urn, transformation_type, 'producer', target_column_urn FROM v_column_edges WHERE target_column_urn IN (SELECT urn FROM seeds)""")
def g8_edge_rows(c: Catalog):
    nodes = c.view("v_column_nodes").filter("layer = 'silver'").select("urn")
    return lineage.neighbour_edges(c.view("v_column_edges").select("source_column_urn", "target_column_urn", "transformation_type"), nodes, "source_column_urn", "target_column_urn")
