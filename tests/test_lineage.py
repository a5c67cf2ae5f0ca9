"""Traversal against a plain breadth-first search on small graphs with cycles and diamonds."""

import random

import pytest

from metaloom.operators import lineage
from metaloom.operators.joins import salted_join


def graph(seed, nodes=25, edges=60):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(edges)})


def brute(edges, depth, start=0, end=1):
    out = {}
    for seed in {e[start] for e in edges}:
        level, seen = {seed}, {seed}
        for d in range(1, depth + 1):
            level = {e[end] for e in edges if e[start] in level} - seen
            seen |= level
            for n in level:
                out[(seed, n)] = d
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_shortest_equals_brute_force(spark, direction, hot_rows):
    edges = graph(7)
    df = spark.createDataFrame(edges, "source_urn string, target_urn string")
    got = {(r.seed, r.node): r.depth for r in lineage.traverse(df, direction=direction, max_depth=4, hot_rows=hot_rows).collect()}
    ends = (0, 1) if direction == "downstream" else (1, 0)
    assert got == brute(edges, 4, *ends)


def test_all_depths_counts_every_depth(spark):
    edges = [("a", "b", "x"), ("a", "c", "x"), ("b", "d", "y"), ("c", "d", "z"), ("a", "d", "x"), ("d", "a", "x")]
    df = spark.createDataFrame(edges, "source_urn string, target_urn string, kind string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    rows = lineage.traverse(df, seeds, max_depth=2, mode="all_depths", attributes=["kind"]).collect()
    assert sorted((r.node, r.kind, r.depth) for r in rows) == [("a", "x", 2), ("b", "x", 1), ("c", "x", 1), ("d", "x", 1), ("d", "y", 2), ("d", "z", 2)]


def test_origins_stop_before_a_cycle_and_at_the_limit(spark):
    edges = [("b", "a"), ("c", "b"), ("a", "c"), ("y", "x"), ("z", "y"), ("k", "y")]
    df = spark.createDataFrame(edges, "source_urn string, target_urn string")
    seeds = spark.createDataFrame([("a",), ("x",), ("z",)], "seed string")
    got = {r.seed: (r.origin, r.hops) for r in lineage.origins(df, seeds, 10).collect()}
    assert got == {"a": ("c", 2), "x": ("k", 2)}
    limited = {r.seed: (r.origin, r.hops) for r in lineage.origins(df, seeds, 1).collect()}
    assert limited == {"a": ("b", 1), "x": ("y", 1)}


def test_terminals_are_reached_leaves(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "source_urn string, target_urn string")
    reached = lineage.downstream(df, spark.createDataFrame([("a",)], "seed string"), 5)
    assert sorted(r.node for r in lineage.terminals(df, reached, 5).collect()) == ["c", "d"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(k, i) for i in range(40) for k in ("hot", f"k{i % 5}", f"l{i}")], "k string, i int")
    right = spark.createDataFrame([("hot", "h1"), ("hot", "h2"), ("k1", "v"), ("k9", "w")], "k string, v string")
    plain = left.join(right, "k", how)
    salted = salted_join(left, right, "k", "i", how, hot_rows=5)
    assert sorted(map(tuple, salted.select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8, 13, 40])
def test_origins_equal_step_by_step_walks(spark, limit):
    r = random.Random(21)
    edges = sorted({(f"n{r.randrange(70)}", f"n{k}") for k in range(60)} | {(f"p{k}", f"p{k + 1}") for k in range(30)} | {("s", "s"), ("s", "t"), ("q1", "q0"), ("q2", "q1"), ("q0", "q2")})
    parent = {}
    for a, b in edges:
        parent[b] = min(a, parent.get(b, a))
    want = {}
    for seed in {x for e in edges for x in e}:
        trail = [seed]
        while len(trail) <= limit and trail[-1] in parent and parent[trail[-1]] not in trail:
            trail.append(parent[trail[-1]])
        if len(trail) > 1:
            want[seed] = (trail[-1], len(trail) - 1)
    df = spark.createDataFrame(edges, "source_urn string, target_urn string")
    seeds = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})] + [("gone",), (None,), ("p3",)], "seed string")
    for hot in (1_000_000, 2) if limit == 5 else (1_000_000,):
        assert {x.seed: (x.origin, x.hops) for x in lineage.origins(df, seeds, limit, hot_rows=hot).collect()} == want


def test_seeds_of_a_node_share_rows(spark):
    """40 seeds that reach 30 nodes are 1,200 pairs in the result and few rows on the way."""
    import glob

    from metaloom.staging import staging_root

    edges = [(f"s{s}", f"n{n}") for s in range(40) for n in range(30)]
    stages = set(glob.glob(f"{staging_root(spark)}/traverse-*"))
    got = {(r.seed, r.node): r.depth for r in lineage.downstream(spark.createDataFrame(edges, "source_urn string, target_urn string"), None, 2).collect()}
    assert got == brute(edges, 2)
    (made,) = set(glob.glob(f"{staging_root(spark)}/traverse-*")) - stages
    assert spark.read.parquet(f"{made}/levels/depth=1").count() <= 120
