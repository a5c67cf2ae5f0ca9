"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie at most eps = sqrt(2 - 2 t) apart, and their projections on any direction differ by
eps at most. Vectors are projected on the leading principal directions (from the covariance, one grouped sum of fixed
size) and ordered by label and by the cells of a grid of width eps, lexicographically. The order is cut into intervals
of ``LEAF`` vectors, and ``FAN`` neighbouring intervals form one of the next level, up to one root for each label; each
interval knows the box of its projections.

The join recurses over pairs of intervals: a pair whose boxes are more than eps apart in some direction is dropped for
good, others are replaced by the pairs of their parts, level by level, as a table. Pairs of leaves that are left
are compared vector by vector in double precision. Bounds hold exactly (up to a margin for rounding), so no link is lost.

Equal vectors of one label are one class with a count, so a vector with a third of all rows is one row of the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metaloom import staging
from metaloom.llm.components import components

THRESHOLD = 0.93
#: directions of the grid
AXES = 6
LEAF, FAN = 256, 8
MARGIN = 1e-6


def _unit(frame: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors of the usable rows) in double precision; vectors of another length than the first aren't usable together."""
    rows = frame.to_pylist()
    ok = np.array([x is not None and len(x) > 0 and None not in x for x in rows], bool)
    vectors = [np.array(x, np.float64) if good else None for x, good in zip(rows, ok)]
    for k, v in enumerate(vectors):
        if v is not None:
            top = np.abs(v).max() if np.isfinite(v).all() else 0.0
            if top == 0.0:
                ok[k] = False
            else:
                v = v / top  # no overflow in the square
                vectors[k] = v / math.sqrt(float(v @ v))
    return ok, vectors


def prepared(vectors: DataFrame) -> DataFrame:
    """Classes of equal usable vectors: rep, label, size (of the vector), copies, unit (doubles)."""
    rows = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL")
    classes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    kinds = dict(vectors.dtypes)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ok, unit = _unit(frame.column(3))
            some = pa.array(np.flatnonzero(ok))
            kept = [v for v in unit if v is not None]
            kept = [v for v, good in zip(unit, ok) if good]
            yield pa.RecordBatch.from_arrays(
                [frame.column(k).take(some) for k in range(3)] + [pa.array([len(v) for v in kept], pa.int32()), pa.array([v.tobytes() for v in kept], pa.binary())], ["rep", "label", "copies", "size", "unit"]
            )

    return classes.select("rep", "label", "copies", "embedding").mapInArrow(batches, f"rep {kinds['vec_id']}, label {kinds['label']}, copies long, size int, unit binary")


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each size of vectors; size x size numbers reach the driver, whatever the number of rows."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            sizes = frame.column(0).to_numpy(zero_copy_only=False)
            raw = frame.column(1).to_pylist()
            for d in np.unique(sizes):
                m = np.stack([np.frombuffer(raw[k], np.float64) for k in np.flatnonzero(sizes == d)])
                m = np.concatenate([m, np.ones((len(m), 1))], 1)
                sums[int(d)] = sums.get(int(d), 0) + m.T @ m
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["size", "moments"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("moments").to_pylist())
        return pa.table({"size": pa.array([table.column("size")[0].as_py()], pa.int32()), "moments": pa.array([total.tobytes()], pa.binary())})

    out = {}
    for r in classes.select("size", "unit").mapInArrow(batches, "size int, moments binary").groupBy("size").applyInArrow(summed, "size int, moments binary").collect():
        m = np.frombuffer(r["moments"], np.float64).reshape(r["size"] + 1, -1)
        mean = m[:-1, -1] / m[-1, -1]
        _, vectors = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[r["size"]] = vectors[:, ::-1][:, :AXES]
    return out


def _leaves(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Classes with their projections and ``leaf``, the number of the interval within (label, size), in grid order."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            points = [np.frombuffer(u, np.float64) @ axes[d] for d, u in zip(frame.column(3).to_pylist(), frame.column(4).to_pylist())]
            points = [np.pad(p, (0, AXES - len(p))) for p in points]  # short vectors have fewer directions
            cells = [np.floor(p / eps).astype(np.int64).tolist() for p in points]
            yield pa.RecordBatch.from_arrays(
                [*frame.columns, pa.array([p.tolist() for p in points], pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64()))], [*frame.schema.names, "point", "cells"]
            )

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, point array<double>, cells array<long>"
    projected = staging.stage(classes.mapInArrow(batches, schema), staging.new_stage(classes.sparkSession, "ego-points"))
    # ranks without one task for each label: the first two cells count first, ranks are taken within them
    lead = F.slice("cells", 1, 2)
    spread = projected.withColumn("lead", lead).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(8)))
    counts = spread.groupBy("label", "size", "lead", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("label", "size").orderBy("lead", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("label", "size", "lead", "part").orderBy("cells", "rep")) - 1
    ranked = spread.withColumn("rank", rank).join(counts, ["label", "size", "lead", "part"])
    return ranked.select("rep", "label", "size", "copies", "unit", "point", F.floor((F.col("offset") + F.col("rank")) / LEAF).alias("leaf"))


def _box(rows: DataFrame, low: str, high: str) -> DataFrame:
    bounds = [f(F.col(c)[k]).alias(f"{n}{k}") for k in range(AXES) for f, c, n in ((F.min, low, "l"), (F.max, high, "h"))]
    boxed = rows.groupBy("label", "size", "node").agg(*bounds)
    return boxed.select("label", "size", "node", F.array(*(f"l{k}" for k in range(AXES))).alias("low"), F.array(*(f"h{k}" for k in range(AXES))).alias("high"))


def linked_classes(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, label, copies, size, unit; links: rep, others, root).

    There is a row of links for each pair of leaves and each class that has a link in it: the vectors linked with it there
    (copies counted), and the least class that is connected with it there. The pairs themselves, quadratic in a family of
    near copies, never leave the task that finds them.
    """
    spark = vectors.sparkSession

    def stage(df: DataFrame, label: str) -> DataFrame:
        return staging.stage(df, staging.new_stage(spark, label))

    classes = stage(prepared(vectors), "ego-classes")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + MARGIN
    kind = dict(classes.dtypes)
    schema = f"rep {kind['rep']}, others long, root {kind['rep']}"
    none = spark.createDataFrame([], schema)
    axes = directions(classes)
    if not axes:
        return classes, none
    leaves = stage(_leaves(classes, axes, eps), "ego-leaves")
    levels = [stage(_box(leaves.withColumnRenamed("leaf", "node"), "point", "point"), "ego-boxes")]
    while levels[-1].agg(F.max("node")).first()[0] > 0:
        above = levels[-1].withColumn("node", F.floor(F.col("node") / FAN))
        levels.append(stage(_box(above, "low", "high"), "ego-boxes"))

    pairs = levels[-1].select("label", "size", F.col("node").alias("a"), F.col("node").alias("b"))
    apart = " AND ".join(f"x.low[{k}] <= y.high[{k}] + {eps!r} AND y.low[{k}] <= x.high[{k}] + {eps!r}" for k in range(AXES))
    for boxes in levels[-2::-1]:
        parts = boxes.withColumn("up", F.floor(F.col("node") / FAN))
        # FAN * FAN pairs for each pair that is left
        x = pairs.join(parts.select("label", "size", F.col("up").alias("a"), F.col("node").alias("xn"), F.struct("low", "high").alias("x")), ["label", "size", "a"])
        y = x.join(parts.select("label", "size", F.col("up").alias("b"), F.col("node").alias("yn"), F.struct("low", "high").alias("y")), ["label", "size", "b"])
        pairs = stage(y.where("xn <= yn").where(apart).select("label", "size", F.col("xn").alias("a"), F.col("yn").alias("b")), "ego-pairs")

    filled = leaves.groupBy("label", "size", "leaf").agg(F.sort_array(F.collect_list(F.struct("rep", "copies", "unit"))).alias("rows"))  # LEAF rows each, in one order wherever they are read
    met = pairs.join(filled.select("label", "size", F.col("leaf").alias("a"), F.col("rows").alias("ra")), ["label", "size", "a"])
    met = met.join(filled.select("label", "size", F.col("leaf").alias("b"), F.col("rows").alias("rb")), ["label", "size", "b"])

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for same, ra, rb in zip(frame.column(0).to_pylist(), frame.column(1), frame.column(2)):
                (ia, ca, ua), (ib, cb, ub) = ((np.array([x["rep"] for x in r]), np.array([x["copies"] for x in r]), np.stack([np.frombuffer(x["unit"], np.float64) for x in r])) for r in (ra.as_py(), (ra if same else rb).as_py()))
                linked = ua @ ub.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                root_a, root_b = _roots(linked, ia, ib)
                sides = [(ia, linked @ cb, root_a)] if same else [(ia, linked @ cb, root_a), (ib, linked.T @ ca, root_b)]
                for ids, others, root in sides:
                    some = others > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some].tolist(), rep_type), pa.array(others[some].astype(np.int64)), pa.array(root[some].tolist(), rep_type)], ["rep", "others", "root"])

    rep_type = to_arrow_type(classes.schema["rep"].dataType)
    found = met.select((F.col("a") == F.col("b")).alias("same"), "ra", "rb").mapInArrow(compare, schema)
    return classes, stage(found, "ego-links")


def _roots(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix, the least id that it is connected with."""
    every, rank = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    a, b = rank[: len(ids_a)].astype(np.int64), rank[len(ids_a) :].astype(np.int64)
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], len(every)).min(0, initial=len(every)))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], len(every)).min(1, initial=len(every)))
        if ids_a is ids_b or len(ids_a) == len(ids_b) and np.array_equal(ids_a, ids_b):  # one set on both sides
            new_a = new_b = np.minimum(new_a, new_b)
        if np.array_equal(new_a, a) and np.array_equal(new_b, b):
            return every[a], every[b]
        a, b = new_a, new_b


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and those without a label, link with nothing:
    no links, a component of their own, kept. Vectors of different length never link. Repeated rows (equal id and vector) count
    as vectors of their own. A row without vec_id takes no part: no links, no component, not kept.
    """
    classes, links = linked_classes(vectors, threshold)
    others = links.groupBy("rep").agg(F.sum("others").alias("others"))
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("rep", "label", "copies").join(others, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    rows = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "label", "embedding")
    least = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"))
    member = rows.join(least, ["label", "embedding"]).select("vec_id", "rep", "label")
    placed = member.join(known, ["rep", "label"], "left").select(
        "vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.coalesce("component", "rep")).alias("component_id")
    )
    rest = vectors.where("label IS NULL OR vec_id IS NULL OR embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
