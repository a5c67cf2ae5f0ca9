"""Operators that share work among equal rows, against the plain way."""

from metaloom.sources import orchestrator


def test_model_edges_of_tasks_that_share_selectors(spark):
    """Tasks with several selectors, equal choices on many tasks, repeated URNs of a node; split choices give the same rows."""
    tasks = [(f"t{k}", "x", "dbt", {"select": "tag:a"}) for k in range(20)] + [("t0", "x", "dbt", {"select": "m1"}), ("t30", "dbt_run_m2", "DbtRun", {}), ("t31", "m1", "python", {}), (None, "m1", "dbt", {})]
    tasks = spark.createDataFrame(tasks, "task_urn string, name string, operator string, params map<string, string>")
    nodes = [("model.p.m1", "model", "m1", "p", ["a"], ["model.p.m2", "source.p.s"]), ("model.p.m2", "model", "m2", "p", ["a", "b"], ["model.p.m3"]), ("model.p.m3", "model", "m3", "p", [], [])]
    nodes = spark.createDataFrame(nodes, "unique_id string, resource_type string, name string, package_name string, tags array<string>, depends_on array<string>")
    urns = spark.createDataFrame([("model.p.m1", "u1"), ("model.p.m2", "u2"), ("model.p.m3", "u3"), ("model.p.m3", "u3")], "unique_id string, urn string")
    want = []
    for task, models in [(f"t{k}", (1, 2)) for k in range(20)] + [("t30", (2,)), ("", (1,))]:
        want += [(task, f"u{m}", "produces") for m in models] + [(task, f"u{m + 1}", "consumes") for m in models for _ in range(m)]
    for hot in (1_000_000, 5):
        edges = orchestrator.model_edges(tasks, nodes, urns, hot_rows=hot)
        assert sorted((r.task_urn or "", r.capsule_urn, r.edge_type) for r in edges.collect()) == sorted(want)


def test_compare_stages_tokens_of_its_pairs_only(spark):
    """100 tables, one pair; a pair given once comes once, whatever tokens both sides have."""
    import glob

    from metaloom.operators import similarity as sim
    from metaloom.staging import staging_root

    fields = "urn string, name string, description string, capsule_type string, layer string, domain string, tags array<string>"
    capsules = spark.createDataFrame([(f"t{k}", f"dim_t{k}", None, "model", "gold", "d", []) for k in range(100)], fields)
    columns = spark.createDataFrame([(f"t{k}", f"c{j}", "INT") for k in range(100) for j in range(k % 2, 4)], "capsule_urn string, name string, data_type string")
    edges = spark.createDataFrame([("s", f"t{k}", "flows_to") for k in range(100)], "source_urn string, target_urn string, edge_type string")
    before = set(glob.glob(f"{staging_root(spark)}/similar-*"))
    (row,) = sim.compare(capsules, columns, edges, spark.createDataFrame([("t0", "t1")], "a string, b string")).collect()
    assert (row.a, row.b, row.schema_score, row.lineage_score) == ("t0", "t1", 0.75, 1.0)
    (made,) = set(glob.glob(f"{staging_root(spark)}/similar-*")) - before
    assert spark.read.parquet(f"{made}/schema").count() == 7
    assert spark.read.parquet(f"{made}/upstream").count() == 2


def test_points_in_intervals_are_not_broadcast(spark, tmp_path):
    """A small table of points is many rows once it looks into every level."""
    from metaloom.operators import intervals

    spark.range(50).selectExpr("id AS key", "timestamp_ntz'2001-01-02' AS at").write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    spans = spark.range(200).selectExpr("id % 50 AS key", "id AS s", "timestamp_ntz'2001-01-01' AS valid_from", "timestamp_ntz'2001-01-01' + make_dt_interval(CAST(id % 20 AS INT)) AS valid_to")
    found = intervals.as_of(points, spans, ["key"], "at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == sum(k % 20 > 1 for k in range(200))
