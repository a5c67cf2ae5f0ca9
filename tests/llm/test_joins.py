"""Near duplicates of texts and of vectors against brute force (operators 2 and 10), and components."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import ego_join, jaccard_join
from metaloom.llm.components import components


def brute_components(ids, linked):
    of = {i: i for i in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {i for e in edges for i in e if e[0] != e[1]}
    assert got == {i: c for i, c in brute_components({i for e in edges for i in e}, edges).items() if i in ids}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_similar_documents(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "  ", "One two", "one TWO", "É x", "é x"]
    for family in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(1, 14))]) for _ in range(40)]
    texts += [texts[8]] * 5
    docs = spark.createDataFrame([(k, t, 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, n int, rep string")
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    wanted = brute_components(range(len(sets)), linked)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_documents(docs).collect()}
    assert got == {k: (len(s), wanted[k]) for k, s in enumerate(sets)}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {k for k, c in wanted.items() if k == c}


def test_similar_documents_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar_documents(docs).count() == 0
    one = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c d"), (2, "C D")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in jaccard_join.similar_documents(one).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_one_of_each_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "A b", 7, 8), (3, "c", 9, 0)], "doc_id long, text string, _kept int, _KEPT_ int")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(x) for x in kept.collect()) == [(1, "a b", 5, 6), (3, "c", 9, 0)]


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string"])
def test_near_vectors_with_ids_of_other_types(spark, kind):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)], "i int, embedding array<double>, label int")
    got = ego_join.near_duplicates(table.selectExpr(f"cast(i as {kind}) as vec_id", "embedding", "label"))
    assert dict(got.dtypes)["component_id"] == kind and sorted((int(x.vec_id), x.n_links, int(x.component_id)) for x in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_signature_bounds_hold():
    r = np.random.default_rng(5)
    for _ in range(200):
        pool = r.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 400))) for _ in range(2))
        assert jaccard_join.overlap_bound(len(a), jaccard_join.signature(a), jaccard_join.signature(b)) >= len(np.intersect1d(a, b))


def test_near_vectors(spark):
    r = np.random.default_rng(6)
    rows = []
    for family in range(60):
        centre = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            rows.append((len(rows), (centre + r.normal(size=16) * 0.12).tolist(), int(r.integers(0, 3))))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(20)]
    good = list(rows)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(bad)] + [(len(rows) + len(bad), good[0][1], None)]
    table = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, rep string")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in good}
    label = {i: x for i, _, x in good}
    linked = [(a, b) for a in unit for b in unit if b < a and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    wanted = brute_components([x[0] for x in rows], linked)
    links = {x[0]: sum(x[0] in p for p in linked) for x in rows}
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in ego_join.near_duplicates(table).collect()}
    assert linked and got == {i: (links[i], wanted[i], wanted[i] == i) for i in links}
    assert ego_join.near_duplicates(table.limit(0)).count() == 0


@pytest.fixture()
def any_order(spark, monkeypatch):
    """Lists are collected in another order each time that they are read."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    collected = F.collect_list
    shuffled = F.udf(lambda xs: random.sample(xs, len(xs)), "array<struct<rep:bigint,copies:bigint,unit:binary>>")
    monkeypatch.setattr(ego_join.F, "collect_list", lambda c: shuffled(collected(c)))
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_near_vectors_in_any_order_of_arrival(spark, any_order):
    r = np.random.default_rng(17)
    rows = []
    while len(rows) < 1500:  # some leaves for each of two labels
        centre = r.normal(size=16)
        for _ in range(r.integers(1, 5)):
            rows.append((len(rows), (centre + r.normal(size=16) * 0.15).tolist(), len(rows) % 2))
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([x for _, _, x in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    wanted = brute_components(range(len(rows)), np.argwhere(near).tolist())
    got = {x.vec_id: (x.n_links, x.component_id) for x in ego_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert near.any() and got == {k: (int(near[k].sum()), wanted[k]) for k in range(len(rows))}
