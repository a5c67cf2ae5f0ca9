"""Records of JSON files in every layout, and the accounting of what is dropped."""

import json
import random

import numpy as np
import pytest

from metaloom.sources import accounting, datasource, json_records, manifest, orchestrator, registry

ODD = ['{"', "}", "\\", '\\"', 'a"}{"b', "{{", "é😀", "\n", "", "\\\\"]


def things(seed, n):
    r = random.Random(seed)
    return [{"dag_id": f"d{k}", "description": r.choice(ODD) + r.choice(ODD), "tags": [r.choice(ODD)], "tasks": [{"task_id": r.choice(ODD) or "t"}] * r.randrange(3)} for k in range(n)]


LAYOUTS = {
    "lines": lambda xs: "\n".join(json.dumps(x) for x in xs),
    "one line": lambda xs: "".join(json.dumps(x) for x in xs),
    "indented": lambda xs: "\n\n".join(json.dumps(x, indent=2, ensure_ascii=False) for x in xs),
    "array": lambda xs: json.dumps(xs, indent=1),
    "leading blanks": lambda xs: "\n".join("  \t" + json.dumps(x) for x in xs) + "\n ",
    "mark": lambda xs: "﻿" + json.dumps(xs),
    "listed": lambda xs: json.dumps({"dags": xs, "total_entries": len(xs)}),
}


@pytest.mark.parametrize("step", [1, 5, 64, 1 << 22])
def test_scan_finds_every_object(step):
    for name in ("lines", "one line", "indented", "array", "leading blanks"):
        xs = things(step, 12)
        data = LAYOUTS[name](xs).encode()
        objects, problems = json_records.scan(np.frombuffer(data, np.uint8), step)
        assert [json.loads(data[a:b]) for a, b in objects] == xs and problems == []


@pytest.mark.parametrize("step", [1, 3, 1 << 22])
def test_scan_reports_the_rest(step):
    data = b'junk {"a": 1} , x {"b": "}"} } {"c": {"d": 2}'
    objects, problems = json_records.scan(np.frombuffer(data, np.uint8), step)
    assert [data[a:b] for a, b in objects] == [b'{"a": 1}', b'{"b": "}"}']
    assert problems == [(0, "text outside of objects"), (16, "text outside of objects"), (29, "text outside of objects"), (31, "object without an end")]
    assert json_records.scan(np.zeros(0, np.uint8), step) == ([], [])


def test_every_layout_gives_every_workflow(spark, tmp_path):
    for k, (name, write) in enumerate(LAYOUTS.items()):
        (tmp_path / f"{k}.json").write_text(write([{**x, "dag_id": f"{name} {x['dag_id']}"} for x in things(k, 30)]), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    dags, problems = orchestrator.parse_dags(spark, str(tmp_path))
    got = {r.dag_id: r for r in dags.collect()}
    assert set(got) == {f"{name} d{i}" for name in LAYOUTS for i in range(30)} and problems.count() == 0
    for k, name in enumerate(LAYOUTS):
        for x in things(k, 30):
            r = got[f"{name} {x['dag_id']}"]
            assert r.description == x["description"] and [t.task_id for t in r.tasks] == [t["task_id"] for t in x["tasks"]]


def test_broken_records_are_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"dag_id": "x"} {"dag_id": oops} {"dag_id": "y"} {"dag_id": "z"')
    t = registry.load(spark, "orchestrator", {"path": str(tmp_path)})
    assert {r.name for r in t["workflows"].collect()} == {"x", "y"}
    assert sorted((r.position, r.severity, r.message) for r in t["problems"].collect()) == [(16, "error", "not valid JSON"), (49, "error", "object without an end")]


def test_rows_in_are_rows_out_and_problems(spark):
    nodes = spark.createDataFrame(
        [("s", "model.s.a", "model", "a", ["model.s.b", "model.s.gone", "model.s.a"], {"X": ["model.s.b.y", "model.s.b.no"], "nope": ["model.s.b.y"]}), ("s", "model.s.b", "model", "b", [], None), ("s", "model.s.c", "model", None, ["x"], None)],
        "project string, unique_id string, resource_type string, name string, depends_on array<string>, depends_on_columns map<string,array<string>>",
    ).selectExpr("*", "'n' as namespace", "null as path", "array('t') as tags", "cast(null as map<string,string>) as meta", "'d' as database_name", "'n' as schema_name", "'' as description", "'' as materialization", "cast(array() as array<string>) as data_tests",
                 "cast(null as string) as catalog_col_lineage", f"cast(null as map<string,{manifest.COLUMN}>) as columns")
    columns = spark.createDataFrame([("model.s.a", "x", "a.x"), ("model.s.b", "Y", "b.y")], "unique_id string, name string, urn string")
    catalog = spark.createDataFrame([("model.s.a", "x"), ("model.s.z", "q"), ("model.s.b", "")], "unique_id string, column_name string")
    dags = spark.createDataFrame([("d", [("t", ["u", "v"]), ("u", None)]), (None, [])], "dag_id string, tasks array<struct<task_id:string,downstream_task_ids:array<string>>>")
    notes = spark.createDataFrame([("t", "urn:cat:a:b", "produces"), ("t", "bad", "produces"), ("t", "urn:cat:a:c", "consumes"), ("t", None, "consumes")], "task_urn string, capsule_urn string, edge_type string")
    known = spark.createDataFrame([("urn:cat:a:b",)], "urn string")
    lists = [manifest.checked_capsules(nodes), manifest.checked_edges(nodes), manifest.checked_columns(nodes, catalog), manifest.checked_column_edges(nodes, columns),
             orchestrator.checked_dags(dags), orchestrator.checked_task_edges(dags), orchestrator.checked_annotations(notes, known)]
    counts = {r.list: (r.rows_in, r.rows_out, r.dropped) for r in accounting.list_counts(lists).collect()}
    assert counts == {"capsules": (3, 2, 1), "edges": (4, 2, 2), "catalog_columns": (3, 1, 2), "column_edges": (3, 1, 2), "workflows": (2, 1, 1), "task_edges": (2, 1, 1), "annotations": (4, 1, 3)}
    for got in lists:
        name, n_in, n_out, dropped = got.counts.first()
        assert got.kept.count() == n_out and got.problems.count() == dropped and n_in == n_out + dropped
    rows = {(r.list, r.severity, r.location, r.message) for r in accounting.problem_rows(lists).collect()}
    assert ("edges", "warning", "model.s.gone -> model.s.a", "unknown node") in rows and ("column_edges", "warning", "model.s.b.no -> model.s.a.X", "unknown source column") in rows
    assert ("annotations", "error", "t produces bad", "malformed URN") in rows and ("task_edges", "warning", "d.t.v", "unknown downstream task") in rows
    assert {r.severity: r.n for r in accounting.severities(lists).collect()} == {"error": 5, "warning": 7}


def test_data_source_gives_what_the_source_gives(spark, tmp_path):
    name = datasource.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k, (layout, write) in enumerate(LAYOUTS.items()):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / f"{k}.json").write_text(write([{**x, "dag_id": f"{layout} {x['dag_id']}"} for x in things(k, 20)]), encoding="utf-8")
    (tmp_path / "in" / "_SUCCESS").write_text("{")
    (tmp_path / "in" / "bad.json").write_text('{"dag_id": 1} oops')
    records = spark.read.format(name).option("path", str(tmp_path / "in")).option("step", "100").load()
    got, problems = orchestrator.dags_of_records(records)
    assert {r.dag_id for r in got.collect()} == {f"{layout} d{i}" for layout in LAYOUTS for i in range(20)} | {"1"}
    assert [r.message for r in problems.collect()] == ["text outside of objects"]
    loaded = registry.load(spark, "orchestrator", {"path": str(tmp_path / "in" / "deep")})["workflows"]
    deep = spark.read.format(name).option("path", f"file://{tmp_path}/in/deep").load()
    dags = orchestrator.dags_of_records(deep)[0]
    shown = orchestrator.workflows(dags.filter(orchestrator.included(dags["dag_id"], dags["is_paused"], dags["is_active"])))
    assert sorted(map(str, shown.collect())) == sorted(map(str, loaded.collect())) and loaded.count() == 60


def test_data_source_streams_from_its_mark(spark, tmp_path):
    import os

    name = datasource.register(spark)
    (tmp_path / "in").mkdir()

    def sync():
        stream = spark.readStream.format(name).option("path", str(tmp_path / "in")).option("since", "1000000000").load()
        orchestrator.dags_of_records(stream)[0].select("dag_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.dag_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k, at in enumerate((1, 2, 3)):  # the first is as old as the mark
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"dag_id": f"a{k}"}))
        os.utime(tmp_path / "in" / f"{k}.json", ns=(at * 10**9, at * 10**9))
    assert sync() == ["a1", "a2"]
    (tmp_path / "in" / "3.json").write_text('{"dag_id": "b"}{"dag_id": "c"}')
    assert sync() == ["a1", "a2", "b", "c"]
    assert sync() == ["a1", "a2", "b", "c"]
