"""Source queries: project manifests, workflow exports, annotations, row accounting, over exports made of the given tables."""

from pyspark.sql import functions as F

from metaloom import staging
from metaloom.functions import classify
from metaloom.operators import pii
from metaloom.plans.export_queries import _NODE_SQL, nodes
from metaloom.plans.registry import Catalog, query
from metaloom.sources import accounting, datasource, manifest, orchestrator

# ------------------------------------------------------------ manifests


def _text(name: str):
    return F.col(name).cast("string")


def catalog_columns(c: Catalog):
    """What the warehouse says about the nodes: other spelling, types, a column that the manifest lacks; some nodes aren't there."""
    kind = F.when(F.col("p_type") == "STANDARD", "source").when(F.col("p_type") == "PROMO", "seed").otherwise("model")
    owner = F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("model.gone.p"), _text("p_partkey"))).otherwise(F.concat(kind, F.lit(".shop.p"), _text("p_partkey")))
    item = lambda name, kind, at: F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), F.lit(at).alias("position"))
    items = F.when(F.col("p_size") % 2 == 0, F.array(item("EMAIL", "TEXT", 1), item("Amount", "NUMBER", 2))).otherwise(F.array(item("Amount", "NUMBER", 1)))
    rows = c.table("part").select(owner.alias("unique_id"), F.explode(items).alias("i"), F.create_map(F.lit("rows"), _text("p_size")).alias("stats"))
    return rows.select("unique_id", F.lower("i.column_name").alias("key"), "i.column_name", "i.data_type", "i.position", "stats")


_CATALOG_SQL = """w AS (SELECT CASE WHEN p_size % 9 = 0 THEN concat('model.gone.p', k) ELSE unique_id END AS unique_id, p_size FROM c),
    k AS (SELECT unique_id, 'Amount' AS column_name, 'NUMBER' AS data_type, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS position, p_size FROM w
      UNION ALL SELECT unique_id, 'EMAIL', 'TEXT', 1, p_size FROM w WHERE p_size % 2 = 0)"""


@query("src2_catalog_columns", f"""
    WITH {_NODE_SQL}, {_CATALOG_SQL}, d AS (SELECT unique_id, urn, 'Email' AS name FROM c)
    SELECT concat(c.urn, '.', coalesce(d.name, k.column_name)) AS urn, c.urn AS capsule_urn, coalesce(d.name, k.column_name) AS name, k.data_type, k.position, CAST(k.p_size AS STRING) AS size_stat,
      CASE WHEN d.name IS NOT NULL THEN 'unknown' END AS pii_type, CASE WHEN d.name IS NOT NULL THEN 1 ELSE 0 END AS test_count
    FROM d FULL OUTER JOIN (SELECT k.* FROM k JOIN c USING (unique_id)) k ON k.unique_id = d.unique_id AND lower(k.column_name) = lower(d.name) JOIN c ON c.unique_id = coalesce(d.unique_id, k.unique_id)""")
def src2_catalog_columns(c: Catalog):
    rows = manifest.columns(nodes(c), catalog_columns(c))
    return rows.select("urn", "capsule_urn", "name", "data_type", "position", F.try_element_at("stats", F.lit("rows")).alias("size_stat"), "pii_type", "test_count")


def lineage_nodes(c: Catalog):
    """Nodes that declare column lineage in all three places; some references lead nowhere."""
    rows = nodes(c)
    key = F.regexp_extract("unique_id", "([0-9]+)$", 1).cast("int")
    at = F.regexp_extract(F.col("depends_on")[0], "([0-9]+)$", 1)
    ref = F.concat(F.lit("model.shop.p"), at, F.lit(".email"))
    own = F.when(key % 3 == 0, F.create_map(F.lit("email"), F.array(ref, F.lit("model.shop.p0.email"))))
    listed = F.when(key % 3 == 1, F.concat(F.lit('{"columns":{"email":{"sources":[{"node":"model.shop.p'), at, F.lit('","column":"EMAIL","transformation":"hash"},"source.shop.p'), at, F.lit('.EMAIL"]}}}')))
    by_column = F.transform_values("columns", lambda _, x: x.withField("depends_on", F.when(key % 3 == 2, F.array(ref)).otherwise(x["depends_on"])))
    return rows.withColumns({"depends_on_columns": own, "catalog_col_lineage": listed, "columns": by_column})


_LINEAGE_SQL = """refs AS (SELECT urn, k, unique_id AS target_id, concat('model.shop.p', p_size) AS source_id, 'transform' AS t FROM c WHERE k % 3 = 0
      UNION ALL SELECT urn, k, unique_id, 'model.shop.p0', 'transform' FROM c WHERE k % 3 = 0
      UNION ALL SELECT urn, k, unique_id, concat('model.shop.p', p_size), 'hash' FROM c WHERE k % 3 = 1 UNION ALL SELECT urn, k, unique_id, concat('source.shop.p', p_size), 'transform' FROM c WHERE k % 3 = 1
      UNION ALL SELECT urn, k, unique_id, concat('model.shop.p', p_size), 'passthrough' FROM c WHERE k % 3 = 2)"""


@query("src4_column_edges", f"WITH {_NODE_SQL}, {_LINEAGE_SQL} SELECT concat(s.urn, '.Email') AS source_column_urn, concat(r.urn, '.Email') AS target_column_urn, t AS transformation_type FROM refs r JOIN c s ON s.unique_id = r.source_id")
def src4_column_edges(c: Catalog):
    rows = lineage_nodes(c)
    return manifest.column_edges(rows, manifest.columns(rows))


def _accounts(c: Catalog):
    rows = lineage_nodes(c)
    named = rows.withColumn("name", F.when(F.col("unique_id").endswith("7"), F.lit("")).otherwise(F.col("name")))
    dags = workflow_exports(c)
    return [
        manifest.checked_capsules(named), manifest.checked_edges(rows), manifest.checked_columns(rows, catalog_columns(c)), manifest.checked_column_edges(rows, manifest.columns(rows)),
        orchestrator.checked_dags(dags.withColumn("dag_id", F.when(~F.col("is_paused"), F.col("dag_id")))), orchestrator.checked_task_edges(dags), orchestrator.checked_annotations(_annotated(c), c.view("v_capsules")),
    ]


_TASKS_SQL = """t AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n FROM lineitem), d AS (SELECT s_suppkey AS s, * FROM supplier)"""
_NOTES_SQL = """notes AS (SELECT DISTINCT concat('urn:cat:task:airflow:main:dag_', l_suppkey, '.', CASE l_linenumber % 4 WHEN 0 THEN 'dbt_run_' WHEN 1 THEN 'load_' WHEN 2 THEN 'check_' ELSE 'x_' END, l_linenumber) AS task_urn,
      CASE l_linenumber % 4 WHEN 0 THEN 'produces' WHEN 1 THEN 'consumes' WHEN 2 THEN 'transforms' ELSE 'validates' END AS edge_type,
      CASE WHEN l_quantity > 45 THEN concat('part/', l_partkey) WHEN l_quantity > 40 THEN concat('urn:cat:part:x', l_partkey) ELSE concat('urn:cat:part:', l_partkey) END AS capsule_urn,
      CASE WHEN l_linenumber % 4 < 2 THEN l_returnflag END AS detail FROM lineitem)"""
_PROBLEM_SQL = f"""problems AS (
      SELECT 'capsules' AS list, 'error' AS severity, unique_id AS location, 'node without a name' AS message FROM c WHERE k % 10 = 7
      UNION ALL SELECT 'edges', 'warning', concat(x.d, ' -> ', c.unique_id), 'unknown node' FROM c JOIN (SELECT unique_id AS u, unnest([concat('model.shop.p', p_size), concat('source.shop.p', p_size)]) AS d FROM c) x ON x.u = c.unique_id WHERE x.d NOT IN (SELECT unique_id FROM c)
      UNION ALL SELECT 'catalog_columns', 'warning', concat(unique_id, '.', column_name), 'catalog node not in the manifest' FROM k WHERE unique_id NOT IN (SELECT unique_id FROM c)
      UNION ALL SELECT 'column_edges', 'warning', concat(source_id, '.email -> ', target_id, '.', CASE t WHEN 'passthrough' THEN 'Email' ELSE 'email' END), 'unknown source column' FROM refs WHERE source_id NOT IN (SELECT unique_id FROM c)
      UNION ALL SELECT 'workflows', 'error', '', 'workflow without an id' FROM d WHERE s_acctbal > 7000
      UNION ALL SELECT 'task_edges', 'warning', concat('dag_', t.s, '.', {{name}}, '.x_99'), 'unknown downstream task' FROM t WHERE n % 4 = 3
      UNION ALL SELECT 'annotations', CASE WHEN capsule_urn LIKE 'part/%' THEN 'error' ELSE 'warning' END, concat_ws(' ', task_urn, edge_type, capsule_urn), CASE WHEN capsule_urn LIKE 'part/%' THEN 'malformed URN' ELSE 'unknown table' END
        FROM notes WHERE capsule_urn NOT IN (SELECT urn FROM v_capsules))"""
_TASK_NAME = "concat(CASE t.n % 4 WHEN 0 THEN 'dbt_run_' WHEN 1 THEN 'load_' WHEN 2 THEN 'check_' ELSE 'x_' END, t.n)"
_ALL_SQL = ", ".join([_NODE_SQL, _CATALOG_SQL, _LINEAGE_SQL, _TASKS_SQL, _NOTES_SQL, _PROBLEM_SQL.format(name=_TASK_NAME)])


@query("src25_problem_rows", f"WITH {_ALL_SQL} SELECT * FROM problems")
def src25_problem_rows(c: Catalog):
    return accounting.problem_rows(_accounts(c))


@query("src25_list_counts", f"""
    WITH {_ALL_SQL}, n_in AS (SELECT 'capsules' AS list, count(*) AS rows_in FROM c UNION ALL SELECT 'edges', 2 * count(*) FROM c UNION ALL SELECT 'catalog_columns', count(*) FROM k UNION ALL SELECT 'column_edges', count(*) FROM refs
      UNION ALL SELECT 'workflows', count(*) FROM d UNION ALL SELECT 'task_edges', count(*) FROM (SELECT t.s, t.n FROM t JOIN t u ON u.s = t.s AND u.n = t.n + 1 UNION ALL SELECT s, n FROM t WHERE n % 4 = 3) UNION ALL SELECT 'annotations', count(*) FROM notes)
    SELECT n_in.list, rows_in, rows_in - coalesce(p.n, 0) AS rows_out, coalesce(p.n, 0) AS dropped FROM n_in LEFT JOIN (SELECT list, count(*) AS n FROM problems GROUP BY 1) p ON p.list = n_in.list""")
def src25_list_counts(c: Catalog):
    return accounting.list_counts(_accounts(c))


# --------------------------------------------------- workflow exports


def workflow_exports(c: Catalog):
    """Suppliers as workflow exports, their line numbers as tasks that run one after the other."""
    n = F.col("l_linenumber")
    task = lambda k: F.concat(F.when(k % 4 == 0, "dbt_run_").when(k % 4 == 1, "load_").when(k % 4 == 2, "check_").otherwise("x_"), k.cast("string"))
    lines = c.table("lineitem").select("l_suppkey", n).distinct()
    following = lines.select("l_suppkey", (n - 1).alias("l_linenumber"), F.lit(True).alias("_next"))
    rows = lines.join(following, ["l_suppkey", "l_linenumber"], "left")
    # the last list holds a task that isn't there
    down = F.array_compact(F.array(F.when(F.col("_next"), task(n + 1)), F.when(n % 4 == 3, F.lit("x_99"))))
    delay = F.struct(F.struct(n.cast("int").alias("days"), (10 * n).cast("int").alias("seconds")).alias("__var"))
    of = F.struct(
        task(n).alias("task_id"), F.when(n % 4 == 0, "DbtRunOperator").when(n % 4 == 1, "PostgresOperator").alias("operator_name"), F.struct(F.when(n % 4 == 2, "BashSensor").otherwise("Custom").alias("class_name")).alias("class_ref"),
        F.when(n > 2, n.cast("int")).alias("retries"), F.when(n % 2 == 0, delay).alias("retry_delay"), F.lit(None).cast(orchestrator.DELAY).alias("execution_timeout"), down.alias("downstream_task_ids"),
        F.when(n % 4 == 1, F.lit("insert into t select 1")).alias("sql"), F.when(n % 8 == 4, F.create_map(F.lit("select"), F.lit("tag:Brand#11"))).alias("params"),
    )
    tasks = rows.groupBy("l_suppkey").agg(F.collect_list(of).alias("tasks"))  # a task for each line number, seven at most
    s = c.table("supplier").join(tasks, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return s.select(
        F.concat(F.lit("dag_"), _text("s_suppkey")).alias("dag_id"), F.col("s_name").alias("description"), (F.col("s_acctbal") > 7000).alias("is_paused"), (F.col("s_acctbal") > 1000).alias("is_active"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit('{"__type":"Cron","value":"0 4 * * *"}')).when(F.col("s_suppkey") % 3 == 1, F.lit("@daily")).alias("schedule_interval"), F.array(F.lit("team")).alias("owners"),
        F.array(F.concat(F.lit('{"name":"domain: nation '), _text("s_nationkey"), F.lit('"}')), F.concat(F.lit("x}"), _text("s_suppkey"))).alias("tags"), "tasks",
    )


def _json(df, pretty: bool = False):
    """JSON text of each workflow; schedules and tags that are objects are written as such."""
    plain = F.to_json(F.struct(*df.columns), {"pretty": "true"} if pretty else {})
    unquoted = F.regexp_replace(plain, r'"(\{\\"(?:__type|name)\\"[^{}]*\})"', "$1")
    return F.regexp_replace(unquoted, r'\\"(?=[^{}\[\]]*\})', '"')


def _exported(c: Catalog) -> str:
    """A folder of files in four layouts: lines, many objects on a line, indented, arrays."""
    df = workflow_exports(c)
    key = F.substr("dag_id", F.lit(5)).cast("int")
    path = staging.new_stage(c.spark, "workflow-exports")
    layout = lambda k: df.where(key % 4 == k)
    group = F.floor(key / 64)  # 16 objects at most are put together
    layout(0).select(_json(df).alias("value")).write.text(f"{path}/layout=lines")
    layout(1).groupBy(group).agg(F.concat_ws(" ", F.collect_list(_json(df))).alias("value")).select("value").write.text(f"{path}/layout=line")
    layout(2).select(F.concat(F.lit("  "), _json(df, pretty=True)).alias("value")).write.text(f"{path}/layout=indented")
    layout(3).groupBy(group).agg(F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list(_json(df))), F.lit("\n]")).alias("value")).select("value").write.text(f"{path}/layout=arrays")
    return path


_WORKFLOWS = """
    SELECT concat('urn:cat:pipeline:airflow:main:dag_', s_suppkey) AS urn, s_name AS description, CASE s_suppkey % 3 WHEN 0 THEN '0 4 * * *' WHEN 1 THEN '@daily' END AS schedule_interval, s_acctbal > 7000 AS is_paused, s_acctbal > 1000 AS is_active,
      concat('nation ', s_nationkey) AS domain, concat('x}', s_suppkey) AS second_tag, coalesce(n, 0) AS tasks FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""


def _workflows(dags, problems):
    counts = dags.select(F.concat(F.lit("urn:cat:pipeline:airflow:main:"), "dag_id").alias("urn"), F.coalesce(F.size("tasks"), F.lit(0)).cast("long").alias("tasks"))
    rows = orchestrator.workflows(dags, "main").select("urn", "description", "schedule_interval", "is_paused", "is_active", "domain", F.get("tags", F.lit(1)).alias("second_tag")).join(counts, "urn")
    return rows.unionByName(problems.select(F.concat_ws(" ", "location", "message").alias("urn")), allowMissingColumns=True)


@query("src14_workflows", _WORKFLOWS)
def src14_workflows(c: Catalog):
    return _workflows(*orchestrator.parse_dags(c.spark, f"{_exported(c)}/*/"))


@query("udf3_record_source", _WORKFLOWS)
def udf3_record_source(c: Catalog):
    """The same exports through the registered data source."""
    records = c.spark.read.format(datasource.register(c.spark)).option("path", _exported(c)).load()
    return _workflows(*orchestrator.dags_of_records(records))


@query("src15_dag_filter", """
    SELECT concat('dag_', s_suppkey) AS dag_id, variant FROM supplier, (SELECT 'state' AS variant UNION ALL SELECT 'pattern' UNION ALL SELECT 'deny' UNION ALL SELECT 'allow' UNION ALL SELECT 'all')
    WHERE CASE variant WHEN 'state' THEN s_acctbal > 1000 AND s_acctbal <= 7000 WHEN 'pattern' THEN s_acctbal > 1000 AND s_acctbal <= 7000 AND CAST(s_suppkey AS STRING) LIKE '1%'
      WHEN 'deny' THEN s_acctbal > 1000 AND s_suppkey NOT IN (1, 2) AND CAST(s_suppkey AS STRING) LIKE '1%' WHEN 'allow' THEN s_acctbal <= 7000 AND s_suppkey IN (1, 3) ELSE true END""")
def src15_dag_filter(c: Catalog):
    rows = workflow_exports(c).select("dag_id", "is_paused", "is_active")
    keep = lambda **k: orchestrator.included(F.col("dag_id"), F.col("is_paused"), F.col("is_active"), **k)
    variants = {"state": keep(), "pattern": keep(pattern="dag_1"), "deny": keep(include_paused=True, deny=["dag_1", "dag_2"], pattern="dag_1"), "allow": keep(include_inactive=True, allow=["dag_1", "dag_3"], deny=["dag_1"]), "all": keep(include_paused=True, include_inactive=True)}
    marked = rows.select("dag_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in variants.items()]))).alias("variant"))
    return marked


@query("src16_tasks", f"""
    WITH {_TASKS_SQL} SELECT concat('urn:cat:task:airflow:main:dag_', t.s, '.', {_TASK_NAME}) AS task_urn, concat('urn:cat:pipeline:airflow:main:dag_', t.s) AS pipeline_urn, CASE n % 4 WHEN 0 THEN 'dbt' WHEN 1 THEN 'sql' WHEN 2 THEN 'bash' ELSE 'custom' END AS task_type,
      CASE n % 4 WHEN 0 THEN 'transform' WHEN 1 THEN 'load' WHEN 2 THEN 'validate' ELSE 'unknown' END AS operation_type, CASE WHEN n > 2 THEN n ELSE 0 END AS retries, CASE WHEN n % 2 = 0 THEN n * 86400 + 10 * n END AS retry_delay_seconds, CASE WHEN n % 4 = 1 THEN 'insert into t select 1' END AS sql FROM t""")
def src16_tasks(c: Catalog):
    return orchestrator.tasks(workflow_exports(c), "main").select("task_urn", "pipeline_urn", "task_type", "operation_type", "retries", "retry_delay_seconds", "sql")


@query("src17_task_edges", f"""
    WITH {_TASKS_SQL}, named AS (SELECT t.s, t.n, concat('urn:cat:task:airflow:main:dag_', t.s, '.', {_TASK_NAME}) AS urn FROM t)
    SELECT concat('urn:cat:pipeline:airflow:main:dag_', s) AS source_urn, urn AS target_urn, 'contains' AS edge_type FROM named
    UNION ALL SELECT a.urn, b.urn, 'depends_on' FROM named a JOIN named b ON b.s = a.s AND b.n = a.n + 1 UNION ALL SELECT urn, concat('urn:cat:task:airflow:main:dag_', s, '.x_99'), 'depends_on' FROM named WHERE n % 4 = 3""")
def src17_task_edges(c: Catalog):
    return orchestrator.task_edges(workflow_exports(c), "main")


def _annotated(c: Catalog):
    """Annotation files of the tasks: tables as URNs or as objects with an operation or access pattern."""
    n, urn = F.col("l_linenumber"), F.concat(F.lit("urn:cat:part:"), _text("l_partkey"))
    urn = F.when(F.col("l_quantity") > 45, F.concat(F.lit("part/"), _text("l_partkey"))).when(F.col("l_quantity") > 40, F.concat(F.lit("urn:cat:part:x"), _text("l_partkey"))).otherwise(urn)
    detail = F.when(n % 4 == 0, "operation").otherwise("access_pattern")
    item = F.when(n % 4 < 2, F.concat(F.lit('{"urn":"'), urn, F.lit('","'), detail, F.lit('":"'), "l_returnflag", F.lit('"}'))).otherwise(urn)
    task = F.concat(F.when(n % 4 == 0, "dbt_run_").when(n % 4 == 1, "load_").when(n % 4 == 2, "check_").otherwise("x_"), n.cast("string"))
    one = lambda k: F.when(n % 4 == k, F.array(item))
    of = F.struct(task.alias("task_id"), one(1).alias("consumes"), one(0).alias("produces"), one(2).alias("transforms"), one(3).alias("validates"))
    files = c.table("lineitem").select(F.array(F.struct(F.concat(F.lit("dag_"), _text("l_suppkey")).alias("pipeline_id"), F.lit("main").alias("instance"), F.array(of).alias("tasks"))).alias("pipelines"))
    return orchestrator.annotation_edges(files).distinct()


@query("src18_annotation_edges", f"WITH {_NOTES_SQL} SELECT task_urn, capsule_urn, edge_type, detail FROM notes")
def src18_annotation_edges(c: Catalog):
    return _annotated(c)


@query("src19_model_edges", f"""
    WITH {_NODE_SQL}, {_TASKS_SQL}, runs AS (SELECT concat('urn:cat:task:airflow:main:dag_', s, '.dbt_run_', n) AS task_urn, n FROM t WHERE n % 4 = 0),
    picked AS (SELECT task_urn, c.* FROM runs JOIN c ON kind = 'model' AND CASE WHEN n % 8 = 4 THEN p_brand = 'Brand#11' ELSE c.name = CAST(n AS STRING) END)
    SELECT task_urn, urn AS capsule_urn, 'produces' AS edge_type FROM picked
    UNION SELECT p.task_urn, s.urn, 'consumes' FROM picked p JOIN c s ON s.unique_id = concat('model.shop.p', p.p_size)""")
def src19_model_edges(c: Catalog):
    rows = nodes(c)
    return orchestrator.model_edges(orchestrator.tasks(workflow_exports(c), "main"), rows, manifest.capsules(rows).select("unique_id", "urn"))


# ------------------------------------------------------------ functions


@query("f11_tag_domains", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN lower(p_type) END AS domain FROM part")
def f11_tag_domains(c: Catalog):
    size, empty = F.col("p_size") % 3, F.lit("area:  ")
    tags = F.when(size == 0, F.array(F.lit("x"), empty, F.concat(F.lit("area: "), "p_brand"), F.concat(F.lit("area:"), "p_name"))).when(size == 1, F.array(F.concat(F.lit("area:"), F.lower("p_type")))).otherwise(F.array(F.lit("Area:no"), empty))
    return c.table("part").select("p_partkey", classify.domain_of_tags(tags, "area:").alias("domain"))


@query("f18_durations", "SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 400 END, 0) * 86400 + coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 0) AS BIGINT) AS seconds FROM orders")
def f18_durations(c: Catalog):
    key = F.col("o_orderkey")
    days, seconds = F.when(key % 3 > 0, (key % 400).cast("int")), F.when(key % 2 == 0, F.col("o_custkey").cast("int"))
    return c.table("orders").select("o_orderkey", classify.duration_seconds(days, seconds).cast("long").alias("seconds"))


@query("f21_nested_texts", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'aggregate' WHEN 1 THEN 'arithmetic' WHEN 2 THEN 'formula' ELSE 'identity' END AS kind FROM part""")
def f21_nested_texts(c: Catalog):
    """Expressions over part names, nested as deep as the part's size."""
    size, word = F.col("p_size"), F.translate("p_name", " ", "_")
    deep = F.concat(F.repeat(F.lit("(a - ("), size), word, F.repeat(F.lit(") - b)"), size))
    text = F.when(size % 4 == 0, F.concat(F.lit("max("), deep, F.lit(")"))).when(size % 4 == 1, F.concat(F.lit("f("), deep, F.lit(") + 1"))).when(size % 4 == 2, F.concat(F.lit("f("), deep, F.lit(")"))).otherwise(word)
    return c.table("part").select("p_partkey", classify.transformation_of(text)["transformation_type"].alias("kind"))


_OWN_PATTERNS = {"handset": ["^phone_"], "money": ["amount"], "number": ["^ssn_[0-3]$"]}


@query("udf4_own_patterns", "SELECT urn, CASE WHEN name LIKE 'phone%' THEN 'handset' WHEN name LIKE 'amount%' THEN 'money' WHEN name LIKE 'ssn%' AND variant < 4 THEN 'number' END AS pii_type FROM v_columns")
def udf4_own_patterns(c: Catalog):
    return pii.tag_columns(c.view("v_columns"), patterns=_OWN_PATTERNS).select("urn", "pii_type")


@query("udf4_own_layers", f"WITH {_NODE_SQL} SELECT urn, CASE WHEN kind IN ('seed', 'source') THEN 'bronze' WHEN name LIKE 'stg%' THEN 'raw' WHEN p_type = 'ECONOMY' THEN 'mart' END AS layer FROM c")
def udf4_own_layers(c: Catalog):
    return manifest.capsules(nodes(c), layer_names={"raw": ["^stg_"], "mart": ["^mart_"]}, layer_paths={"raw": ["^raw/"], "mart": ["/economy/"]}).select("urn", "layer")
