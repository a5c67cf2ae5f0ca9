"""Sources read files, sinks write files that parse back, streaming merges batches."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from metaloom.operators import property_graph
from metaloom.sinks import export, upsert
from metaloom.sources import manifest, orchestrator, registry, warehouse
from metaloom.streaming import incremental


def node(kind, name, schema="main", path="", deps=(), columns=None, tags=(), meta=None, **more):
    return {"resource_type": kind, "name": name, "schema": schema, "database": "db", "package_name": "shop", "original_file_path": path, "tags": list(tags), "meta": meta or {},
            "config": {"materialized": "table", "meta": {}}, "depends_on": {"nodes": list(deps)}, "columns": columns or {}, **more}


MANIFEST = {
    "metadata": {"project_name": "shop"},
    "nodes": {
        "model.shop.stg_users": node("model", "stg_users", path="models/staging/stg_users.sql", deps=["source.shop.app.users", "model.shop.gone"], tags=["domain:core"],
                                     columns={"email": {"name": "email", "meta": {"pii": True, "pii_type": "email"}, "tags": [], "data_tests": ["unique", "not_null"]}, "ID": {"name": "ID", "depends_on": ["source.shop.app.users.id"]}}),
        "model.shop.dim_users": node("model", "dim_users", path="models/marts/core/dim_users.sql", deps=["model.shop.stg_users", "seed.shop.kinds"], columns={"email": {"name": "email", "meta": {"sensitive": True}}},
                                     catalog_col_lineage={"columns": {"email": {"sources": [{"node": "model.shop.stg_users", "column": "EMAIL", "transformation": "hash"}, "model.shop.stg_users.id"]}}}),
        "seed.shop.kinds": node("seed", "kinds"), "test.shop.t": node("test", "t"),
    },
    "sources": {"source.shop.app.users": node("source", "users", source_name="app", columns={"id": {"name": "id"}})},
}
CATALOG = {"nodes": {"model.shop.stg_users": {"columns": {"EMAIL": {"type": "TEXT", "index": 2, "stats": {"row_count": {"value": 100, "label": "n"}}}, "extra": {"type": "INT", "index": 3, "stats": {}}}}}, "sources": {}}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    (tmp_path / "c.json").write_text(json.dumps(CATALOG))
    t = registry.load(spark, "manifest", {"manifest_path": str(tmp_path / "m.json"), "catalog_path": str(tmp_path / "c.json")})
    capsules = {r.name: r for r in t["capsules"].collect()}
    assert {k: (v.capsule_type, v.layer) for k, v in capsules.items()} == {"stg_users": ("model", "silver"), "dim_users": ("model", "gold"), "kinds": ("seed", "bronze"), "users": ("source", "bronze")}
    assert capsules["stg_users"].test_count == 2 and capsules["stg_users"].domain == "core"
    assert capsules["users"].urn == "urn:cat:dbt:source:shop.app:users"
    columns = {(r.unique_id, r.name): r for r in t["columns"].collect()}
    email = columns[("model.shop.stg_users", "email")]
    assert (email.pii_type, email.pii_detected_by, email.data_type, email.stats["row_count"], email.test_count) == ("email", "tag", "TEXT", "100", 2)
    assert ("model.shop.stg_users", "extra") in columns and columns[("model.shop.dim_users", "email")].pii_type == "sensitive"
    assert sorted(r.transformation for r in t["edges"].collect()) == ["ref", "ref", "source"]
    assert sorted(r.transformation_type for r in t["column_edges"].collect()) == ["hash", "passthrough", "transform"]
    assert t["problems"].count() == 0


def test_broken_manifest_is_reported(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    problems = manifest.parse_problems(spark, str(tmp_path))
    assert [r.severity for r in problems.collect()] == ["error"]
    with pytest.raises(ValueError):
        registry.load(spark, "manifest", {})


def test_selectors(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    nodes = manifest.read_nodes(spark, str(tmp_path / "m.json"))
    wanted = spark.createDataFrame([("tag:domain:core",), ("dim_users",), ("shop.stg_users",), ("shop.stg*",), ("none",)], "selector string")
    got = sorted((r.selector, r.unique_id) for r in manifest.select_models(wanted, nodes).collect())
    assert got == [("dim_users", "model.shop.dim_users"), ("shop.stg*", "model.shop.stg_users"), ("shop.stg_users", "model.shop.stg_users"), ("tag:domain:core", "model.shop.stg_users")]


def test_orchestrator(spark, tmp_path):
    dag = {"dag_id": "d1", "is_paused": False, "is_active": True, "schedule_interval": {"__type": "Cron", "value": "0 1 * * *"}, "tags": [{"name": "domain:sales"}, "x"], "tasks": [
        {"task_id": "dbt_run_stg_users", "operator_name": "DbtRunOperator", "retry_delay": {"__var": {"days": 1, "seconds": 5}}, "downstream_task_ids": ["load"]},
        {"task_id": "load", "class_ref": {"class_name": "PostgresOperator"}, "sql": "insert into t select 1"}]}
    (tmp_path / "dags").mkdir()
    (tmp_path / "dags" / "d1.json").write_text(json.dumps(dag))
    (tmp_path / "dags" / "d2.json").write_text(json.dumps({**dag, "dag_id": "d2", "is_paused": True}))
    t = registry.load(spark, "orchestrator", {"path": str(tmp_path / "dags")})
    w = t["workflows"].collect()
    assert [(r.name, r.schedule_interval, r.domain) for r in w] == [("d1", "0 1 * * *", "sales")]
    tasks = {r.name: r for r in t["tasks"].collect()}
    assert (tasks["dbt_run_stg_users"].task_type, tasks["dbt_run_stg_users"].retry_delay_seconds, tasks["load"].task_type, tasks["load"].operation_type) == ("dbt", 86405, "sql", "load")
    assert sorted(r.edge_type for r in t["task_edges"].collect()) == ["contains", "contains", "depends_on"]
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    nodes = manifest.read_nodes(spark, str(tmp_path / "m.json"))
    edges = orchestrator.model_edges(t["tasks"], nodes, manifest.capsules(nodes).select("unique_id", "urn"))
    assert [(r.edge_type, r.capsule_urn.split(":")[-1]) for r in edges.collect()] == [("produces", "stg_users")]


def test_dag_filters(spark):
    df = spark.createDataFrame([("a", False, True), ("b", True, True), ("c", False, False), ("ab", False, True)], "d string, p boolean, a boolean")
    pick = lambda **k: sorted(r.d for r in df.filter(orchestrator.included(F.col("d"), F.col("p"), F.col("a"), **k)).collect())
    assert pick() == ["a", "ab"]
    assert pick(include_paused=True, include_inactive=True) == ["a", "ab", "b", "c"]
    assert pick(allow=["a", "b"], deny=["a"]) == ["a"]
    assert pick(deny=["a"], pattern="a") == ["ab"]


def test_annotations(spark, tmp_path):
    doc = {"pipelines": [{"pipeline_id": "p", "tasks": [{"task_id": "t", "consumes": ["urn:cat:a:b", {"urn": "urn:cat:a:c", "access_pattern": "full"}], "produces": [{"urn": "urn:cat:a:d", "operation": "insert"}], "validates": ["bad"]}, {"consumes": ["x"]}]}, {"tasks": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    edges = orchestrator.annotation_edges(orchestrator.read_annotations(spark, str(tmp_path / "a.json")))
    got = sorted((r.edge_type, r.capsule_urn, r.detail) for r in edges.collect())
    assert got == [("consumes", "urn:cat:a:b", None), ("consumes", "urn:cat:a:c", "full"), ("produces", "urn:cat:a:d", "insert"), ("validates", "bad", None)]
    assert [r.capsule_urn for r in orchestrator.malformed_urns(edges).collect()] == ["bad"]


def test_sql_references(spark):
    texts = [("v", 'select * from "Db"."S".T1 join s2.t2 on 1=1 -- from x\n join t3 /* from y */ left join t3')]
    df = spark.createDataFrame(texts, "k string, sql string")
    got = sorted((r.ref_database, r.ref_schema, r.ref_table) for r in warehouse.references(df, "k", "sql", F.lit("d"), F.lit("p")).collect())
    assert got == [("D", "P", "T3"), ("D", "S2", "T2"), ("DB", "S", "T1")]


def test_upsert_null_keys_and_kept_columns(spark):
    schema = "k string, s string, v int, first int"
    old = spark.createDataFrame([("a", None, 1, 1), ("b", "x", 2, 1), ("c", "x", 3, 1)], schema)
    new = spark.createDataFrame([("a", None, 1, 9), ("b", "x", 5, 9), ("d", None, 7, 9)], schema)
    got = {(r.k, r.v, r["first"], r._change) for r in upsert.upsert(old, new, ["k", "s"], keep=["first"]).collect()}
    assert got == {("a", 1, 1, "unchanged"), ("b", 5, 1, "updated"), ("c", 3, 1, "missing"), ("d", 7, 9, "created")}


def graph_tables(spark):
    nodes = spark.createDataFrame([("urn:a", 'A "&" <b>', "table", "gold", None, {"has_pii": "true", "x": ""}), ("urn:b", "B", "table", None, "d", {})], "urn string, name string, node_type string, layer string, domain string, properties map<string,string>")
    edges = spark.createDataFrame([("urn:a", "urn:b", "FLOWS_TO"), ("urn:a", "urn:c", "FLOWS_TO"), ("urn:a", "urn:d", "FLOWS_TO"), ("urn:z", "urn:a", "CONTAINS")], "source_urn string, target_urn string, edge_type string")
    return nodes, edges


def test_graphml_parses(spark, tmp_path):
    out = str(tmp_path / "g")
    export.write_text(export.graphml(*graph_tables(spark)), out)
    text = "\n".join(r.value for r in spark.read.text(out).collect())
    root = ET.fromstring("\n".join(r.value for r in export.graphml(*graph_tables(spark)).orderBy("part", "value").collect()))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    names = [d.text for n in root.iter(f"{space}node") for d in n if d.get("key") == "name"]
    assert sorted(names) == ['A "&" <b>', "B"] and len(list(root.iter(f"{space}edge"))) == 4
    assert text.count("<edge ") == 4


def test_jsonld_pieces_merge_to_the_whole(spark):
    nodes, edges = graph_tables(spark)
    merged = {}
    for r in export.jsonld(nodes, edges).collect():
        for k, v in json.loads(r.value).items():
            if k == "flowsTo":
                merged.setdefault((r.urn, k), []).append(v)
    assert {k: sorted(v) for k, v in merged.items()} == {("urn:a", "flowsTo"): ["urn:b", "urn:c", "urn:d"]}


def test_cypher_escapes(spark):
    lines = [r.value for r in export.cypher(*graph_tables(spark)).filter("part = 1").collect()]
    assert 'CREATE (:TABLE {urn: "urn:a", name: "A \\"&\\" <b>", layer: "gold", has_pii: "true"});' in lines


def test_graph_keeps_one_node_per_urn(spark):
    nodes, _ = graph_tables(spark)
    assert property_graph.first_of_each(nodes.union(nodes)).count() == 2


def test_reports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b,c", 2)], "x string, n int")
    for fmt in ("csv", "json"):
        export.write_report(rows, str(tmp_path / fmt), fmt)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(r.x for r in back.collect()) == ["a", "b,c"]
    with pytest.raises(ValueError):
        export.write_report(rows, str(tmp_path / "x"), "html")


def test_incremental_sync(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "urn string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(source)
    run = lambda: incremental.sync_files(spark, source, spark.createDataFrame([], schema).schema, ["urn"], folder, checkpoint).awaitTermination()
    run()
    spark.createDataFrame([("b", 2), ("c", 1)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/version=2").collect())) == [("a", 1), ("b", 2), ("c", 1)]
    delta = {r.entity: r for r in spark.read.parquet(f"{folder}/_delta/version=2").collect()}["rows"]
    assert (delta.created, delta.updated) == (1, 1)
