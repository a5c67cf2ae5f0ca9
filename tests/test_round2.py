"""Cases that earlier versions got wrong: nesting, cron fields, maps, JSON lines, rule declarations."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from metaloom.functions import schedule
from metaloom.functions.classify import transformation_of
from metaloom.operators import conformance
from metaloom.sinks import upsert
from metaloom.sources import orchestrator, registry


def brute_next_run(cron, now):
    """Minute by minute over the fields' sets, for eight years."""
    names = [None, None, None, schedule.MONTH_NAMES, schedule.DAY_NAMES]
    low, high = [0, 0, 1, 1, 0], [59, 23, 31, 12, 7]
    sets = []
    for i, field in enumerate(cron.split()):
        found = set()
        for part in field.upper().split(","):
            for k, name in enumerate(names[i] or []):
                part = part.replace(name, str(k + (i == 3)))
            base, _, step = part.partition("/")
            a, _, b = base.partition("-")
            first, last = (low[i], high[i]) if base == "*" else (int(a), int(b or (high[i] if step else a)))
            found |= set(range(first, last + 1, int(step or 1)))
        sets.append(found)
    week = {d % 7 for d in sets[4]}
    fields = cron.split()
    day = now.date()
    for k in range(8 * 366 + 40):
        d = day + datetime.timedelta(days=k)
        by_day, by_week = d.day in sets[2], (d.weekday() + 1) % 7 in week
        if d.month in sets[3] and (by_day or by_week if "*" not in (fields[2], fields[4]) else by_day and by_week):
            for h in sorted(sets[1]):
                for m in sorted(sets[0]):
                    at = datetime.datetime(d.year, d.month, d.day, h, m)
                    if at > now:
                        return at
    return None


def test_next_run_of_ranges_names_steps_and_leap_days(spark):
    crons = [
        "0 9 * * 1-5", "0 9-17 * * *", "0 0 * * MON", "0 0 */2 * *", "0 0 1 */3 *", "0 0 29 2 *", "*/15 8-18/2 * jan,SEP mon-fri", "30 4 1,15 * 5", "5 0 31 * *",
        "0 0 30 2 *", "0 12 * * 7", "0 12 * * 5-7", "0 0 1 1 *", "10-20/5 10 1-7 * *", "59 23 31 12 *",
    ]
    for now in ("2001-09-01 10:20:00", "2000-02-29 23:59:00", "1999-12-31 00:00:00"):
        rows = spark.createDataFrame([(c,) for c in crons], "c string").select("c", schedule.next_run(F.col("c"), now).alias("n")).collect()
        assert {r.c: r.n for r in rows} == {c: brute_next_run(c, datetime.datetime.fromisoformat(now)) for c in crons}


def test_operators_inside_brackets_of_any_depth_do_not_count(spark):
    deep = "coalesce(" + "f(" * 30 + "a - b" + ")" * 30 + ", 0)"
    texts = {"coalesce(a - nvl(b, f(g(h(i(c))))), 0)": "formula", deep: "formula", "f(g(h(i(j(c))))) - d": "arithmetic", "nvl('(', a) ": "formula"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", transformation_of(F.col("t")).alias("x")).collect()
    assert {r.t: r.x.transformation_type for r in rows} == texts


def test_maps_can_be_upserted(spark):
    schema = "urn string, stats map<string,string>, deep array<map<string,int>>"
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"}, [{"k": 1}]), ("b", {"x": "1"}, None), ("c", None, None)], schema)
    new = spark.createDataFrame([("a", {"y": "2", "x": "1"}, [{"k": 1}]), ("b", {"x": "2"}, None), ("d", {}, []), ("d", {}, [])], schema)
    out = upsert.upsert(old, upsert.one_per_key(new, ["urn"]), ["urn"]).collect()
    assert {r.urn: r._change for r in out} == {"a": "unchanged", "b": "updated", "c": "missing", "d": "created"}
    assert {r.urn: r.stats for r in out}["b"] == {"x": "2"}


def test_every_object_of_a_json_lines_export_is_read(spark, tmp_path):
    dags = [{"dag_id": f"d{k}", "tasks": [{"task_id": "t", "operator_name": "PostgresOperator", "sql": "select 1"}]} for k in range(3)]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(d) for d in dags))
    assert {r.dag_id for r in orchestrator.read_dags(spark, str(lines), "lines").collect()} == {"d0", "d1", "d2"}
    assert {r.dag_id for r in orchestrator.read_dags(spark, str(lines)).collect()} == {"d0", "d1", "d2"}
    with pytest.raises(ValueError, match="layout"):
        orchestrator.read_dags(spark, str(lines), "table")
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(dags[0], indent=1))
    assert orchestrator.read_dags(spark, str(whole)).count() == 1
    urn = "urn:cat:table:x.y"
    notes = tmp_path / "notes.json"
    notes.write_text(json.dumps({"pipelines": [{"pipeline_id": "d0", "tasks": [{"task_id": "t", "consumes": [urn, "bad"]}]}]}, indent=1))
    tables = registry.load(spark, "orchestrator", {"path": str(lines), "layout": "lines", "annotations_path": str(notes)})
    assert {(r.capsule_urn, r.edge_type) for r in tables["data_edges"].collect()} == {(urn, "consumes"), ("bad", "consumes")}
    assert [r.capsule_urn for r in tables["malformed_urns"].collect()] == ["bad"]


def test_the_best_statement_of_a_task_counts(spark):
    rows = spark.createDataFrame([("t", "select", 1), ("t", "insert", 2), ("u", "update", 3), ("u", "insert", 4)], "task_urn string, statement string, n int")
    assert {(r.task_urn, r.n) for r in orchestrator.best_statement(rows).collect()} == {("t", 1), ("u", 4)}


def test_rules_that_nothing_evaluates_are_refused(spark):
    spec = {"id": "r", "name": "n", "description": "d", "severity": "info", "category": "naming", "scope": "capsule"}
    for bad in ({"condition": {"then": {"has_contrakt": True}}}, {"condition": {"if": {"lair": ["gold"]}}}, {"condition": {"requires": "ownr"}}, {"scope": "lineage"}):
        with pytest.raises(ValueError):
            conformance.custom_rule({**spec, **bad})
    none = spark.createDataFrame([], "urn string, name string, capsule_urn string")
    assert conformance.evaluate(none, none, []).count() == 0
