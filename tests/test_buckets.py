"""Bucketed snapshots: what is written, what is switched, what is left."""

import glob
import os

import pytest

from metaloom.sinks.buckets import BucketStore, refresh_view
from metaloom.streaming import incremental

SCHEMA = "k long, v string, m map<string,string>"


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, {"a": v}) for k, v in pairs], SCHEMA)


def store(spark, path, buckets=8):
    return BucketStore(spark, f"file://{path}/s", rows(spark, [(1, "a")]).schema, ["k"], buckets)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/s/data/*/*/part-*")}


def test_a_batch_of_ten_rows_writes_only_its_buckets(spark, tmp_path):
    s = store(spark, tmp_path, 64)
    s.merge(rows(spark, [(k, "a") for k in range(2000)]), 1)
    before, pointer = files(tmp_path), s.pointer()
    changed = s.merge(rows(spark, [(k, "b") for k in range(5)] + [(3000 + k, "n") for k in range(5)]), 2)
    new = {f: t for f, t in files(tmp_path).items() if f not in before}
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    touched = {int(f.split("_bucket=")[1].split("/")[0]) for f in new}
    assert len(touched) <= 10 and all("version=2" in f for f in new)
    assert {b for b, v in s.pointer().items() if v == 2} == touched and all(s.pointer()[b] == v for b, v in pointer.items() if b not in touched)
    assert {r.k: r.v for r in s.read().collect()} == {k: "b" if k < 5 else "a" for k in range(2000)} | {3000 + k: "n" for k in range(5)}
    assert {r.k: r.v for r in s.read(1).collect()} == dict.fromkeys(range(2000), "a")
    assert sorted(r._change for r in changed.collect() if r._change not in ("unchanged", "missing")) == ["created"] * 5 + ["updated"] * 5
    assert [(r.version, r.created, r.updated) for r in s.changes().where("entity = 'rows'").orderBy("version").collect()] == [(1, 2000, 0), (2, 5, 5)]


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    s = store(spark, tmp_path)
    s.merge(rows(spark, [(1, "a"), (2, "a")]), 1)
    s.merge(rows(spark, [(2, "b"), (3, "b")]), 2)
    os.remove(f"{tmp_path}/s/pointers/version=2/_SUCCESS")  # the batch failed before its switch
    assert {r.k: r.v for r in s.read().collect()} == {1: "a", 2: "a"}
    s.merge(rows(spark, [(2, "b"), (3, "b")]), 2)
    assert {r.k: r.v for r in s.read().collect()} == {1: "a", 2: "b", 3: "b"}
    s.merge(rows(spark, [(2, "b"), (3, "b")]), 2)  # and once more
    assert {r.k: r.v for r in s.read().collect()} == {1: "a", 2: "b", 3: "b"}
    with pytest.raises(ValueError, match="older"):
        s.merge(rows(spark, [(9, "z")]), 1)


def test_whole_batches_remove_what_they_dont_bring(spark, tmp_path):
    s = store(spark, tmp_path)
    s.merge(rows(spark, [(k, "a") for k in range(40)]), 1)
    s.merge(rows(spark, [(k, "a") for k in range(10)]), 2, drop_missing=True)
    assert {r.k for r in s.read().collect()} == set(range(10))
    assert [r.deleted for r in s.changes().where("entity = 'rows' AND version = 2").collect()] == [30]


def test_compaction_and_vacuum(spark, tmp_path):
    s = store(spark, tmp_path, 2)
    s.merge(rows(spark, [(k, "a") for k in range(100)]), 1)
    for v in range(2, 5):
        s.merge(rows(spark, [(v, f"v{v}")]), v)
    want = {r.k: r.v for r in s.read().collect()}
    assert s.compact(5, most_files=0) == [0, 1] and {r.k: r.v for r in s.read().collect()} == want
    assert s.compact(6) == []
    s.vacuum(keep=1)
    assert {r.k: r.v for r in s.read().collect()} == want and s.versions() == [5]
    assert {f.split("version=")[1].split("/")[0] for f in files(tmp_path)} == {"5"}


def test_null_keys_and_empty_batches(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.read().count() == 0
    s.merge(rows(spark, []), 1)
    s.merge(spark.createDataFrame([(None, "a", None), (None, "b", None)], SCHEMA), 2)
    assert [(r.k, r.v) for r in s.read().collect()] == [(None, "b")]


def test_refresh_writes_what_changed(spark, tmp_path):
    summary = lambda n: rows(spark, [(k, "a") for k in range(50)] + [(99, n)])
    refresh_view(spark, summary("x"), f"file://{tmp_path}/s", ["k"], 16)
    before = files(tmp_path)
    now, changed = refresh_view(spark, summary("x"), f"file://{tmp_path}/s", ["k"], 16)
    assert files(tmp_path) == before and changed.count() == 0 and now.count() == 51
    now, changed = refresh_view(spark, summary("y"), f"file://{tmp_path}/s", ["k"], 16)
    assert len(set(files(tmp_path)) - set(before)) == 1 and [(r.k, r.v, r._change) for r in changed.collect()] == [(99, "y", "updated")] and now.count() == 51
    now, changed = refresh_view(spark, summary("y").where("k <> 7"), f"file://{tmp_path}/s", ["k"], 16)
    assert [r._change for r in changed.collect()] == ["missing"] and now.count() == 50


def test_stream_into_buckets(spark, tmp_path):
    schema = rows(spark, [(1, "a")]).schema
    for k in range(3):
        rows(spark, [(k, f"b{k}"), (100, f"b{k}")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.sync_buckets(spark, f"{tmp_path}/in", schema, ["k"], f"{tmp_path}/s", f"{tmp_path}/ck", 4).awaitTermination()
    got = {r.k: r.v for r in BucketStore(spark, f"{tmp_path}/s", schema, ["k"], 4).read().collect()}
    assert got == {0: "b0", 1: "b1", 2: "b2", 100: "b2"}
