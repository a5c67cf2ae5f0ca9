"""Substring index and interval bins against brute force."""

import datetime
import random

import pytest

from metaloom.operators import filters, intervals, substring_index


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_substrings_equal_brute_force(spark, hot):
    r = random.Random(4)
    texts = [(k, "".join(r.choices("abé日 ", k=r.randrange(0, 12)))) for k in range(120)] + [(500, None), (501, ""), (0, "abab")]
    patterns = ["".join(r.choices("abé日 ", k=r.randrange(0, 6))) for _ in range(60)] + ["", "zzz", "a", "abab", None]
    got = {(x.pattern, x.id) for x in substring_index.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), hot_rows=hot).collect()}
    assert got == {(p, k) for p in patterns if p is not None for k, t in texts if t is not None and p in t}


def test_substrings_of_nothing(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert substring_index.containing(texts, spark.createDataFrame([], "pattern string")).count() == 0
    assert substring_index.containing(texts.limit(0), spark.createDataFrame([("a",)], "pattern string")).count() == 0


def test_substring_plan_has_no_nested_loop(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, text string")
    plan = substring_index.containing(texts, spark.createDataFrame([("bc",)], "pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_in_intervals_equal_brute_force(spark):
    r = random.Random(8)
    zero = datetime.datetime(2001, 1, 1)
    time = lambda scale: zero + datetime.timedelta(seconds=r.randrange(-scale, scale))
    spans = []
    for k in range(400):
        start = time(10**8)
        length = datetime.timedelta(seconds=r.choice([0, 1, 3599, 3600, 3601, 14400, 10**5, 10**7, 10**8]))
        spans.append((r.choice(["a", "b", None]), k, None if r.random() < 0.05 else start, None if r.random() < 0.05 else start + length))
    points = [(r.choice(["a", "b", "c", None]), k, time(10**8)) for k in range(200)] + [("a", 900 + k, x) for k, s in enumerate(spans[:40]) for x in (s[2], s[3]) if x is not None] + [("a", 999, None)]
    a = spark.createDataFrame(points, "key string, p int, at timestamp_ntz")
    b = spark.createDataFrame(spans, "key string, s int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = sorted((x.key, x.p, str(x["at"]), x.s) for x in intervals.as_of(a, b, ["key"], "at").collect())
    want = sorted((k, p, str(at), s) for k, p, at in points for j, s, lo, hi in spans if k is not None and k == j and at is not None and (lo is None or lo <= at) and (hi is None or at < hi))
    assert got == want and len(want) > 500
    assert intervals.as_of(a, b.limit(0), ["key"], "at").count() == 0


def test_exists_link(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "x string, y int")
    bridge = spark.createDataFrame([("a", 1, "z"), ("a", 1, "w")], "x string, y int, v string")
    assert sorted(((r.x or "", r.y, r.linked) for r in filters.exists_link(pairs, bridge).collect())) == [("", 1, False), ("a", 1, True), ("a", 2, False)]


def test_quantiles_by_ranges(spark):
    import numpy as np

    from metaloom.operators import profile

    r = random.Random(5)
    columns = {"a": [r.gauss(0, 1) for _ in range(3000)], "b": [float(r.choice([1, 1, 1, 2, 900])) for _ in range(3000)], "c": [float(k) for k in range(2999)] + [None], "d": [None] * 3000, "e": [None] * 2998 + [7.0, 9.0]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{k} double" for k in columns)).repartition(5)
    for most in (10**6, 100, 7):
        got = {(x.column, x.probability): x.value for x in profile.exact_quantiles(df, list(columns), (0.0, 0.25, 0.5, 0.999, 1.0), accuracy=100, most=most).collect()}
        want = {(k, p): float(np.quantile([x for x in v if x is not None], p)) for k, v in columns.items() if k != "d" for p in (0.0, 0.25, 0.5, 0.999, 1.0)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
