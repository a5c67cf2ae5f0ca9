"""Graph operators over edge tables: reachability for all start nodes at once.

``traverse`` expands a frontier of (seed, node) pairs level by level.  Each
level is a join with the edges, and a grouping that leaves out the pairs seen
before; the level is written to the staging folder, so the plan stays one
level deep and survives the loss of executors.  The driver only asks whether a
level is empty.  For shortest depths nodes and seeds are numbered, and the
seeds of a node are bits: sixty of them take one row, one step of a join, and
are told from those seen before by one operation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from metaloom.operators.bits import bit, block, by_block, grouped, named
from metaloom.operators.joins import HOT_ROWS, fan_out, hot_keys, salt_rows, salted_join
from metaloom.operators.label_index import LabelIndex, reachable
from metaloom.staging import drop, new_stage, stage, stage_counted


def _hops(edges: DataFrame, source: str, target: str, direction: str, attributes: Sequence[str]) -> DataFrame:
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"direction must be downstream or upstream, got {direction}")
    start, end = (source, target) if direction == "downstream" else (target, source)
    return edges.select(F.col(start).alias("node"), F.col(end).alias("_next"), *attributes)


def traverse(
    edges: DataFrame,
    seeds: DataFrame | None = None,
    *,
    direction: str = "downstream",
    max_depth: int = 5,
    mode: str = "shortest",
    source: str = "source_urn",
    target: str = "target_urn",
    attributes: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Nodes reachable from every seed within ``max_depth`` hops.

    edges: one row per edge (``source``, ``target`` and any ``attributes``).
    seeds: one column ``seed``; None starts from every node that has a hop.
    mode ``shortest``: (seed, node, depth), each node once at its least depth,
      the seed itself left out.
    mode ``all_depths``: (seed, node, *attributes, depth), a node once per
      distinct depth and distinct attributes of the edge that reached it; walks
      may return to the seed.

    A node with more than ``hot_rows`` hops is split over several tasks.
    """
    if mode not in ("shortest", "all_depths"):
        raise ValueError(f"unknown mode {mode}")
    spark = edges.sparkSession
    path = new_stage(spark, "traverse")
    if mode == "shortest":
        return _shortest(_hops(edges, source, target, direction, ()), seeds, max_depth, hot_rows, path)
    # the edges are read for the hot-key check and once per level: compute them once
    base = _hops(edges, source, target, direction, attributes).persist(StorageLevel.MEMORY_AND_DISK)
    hops = base
    hot, hot_count = stage_counted(hot_keys(hops, "node", hot_rows), f"{path}/hot")
    salted = hot_count > 0
    keys = ["node", "_salt"] if salted else ["node"]
    if salted:
        hops = salt_rows(hops, "node", hot, spread_on="_next")
    if seeds is None:
        # every level meets every edge: shuffle the edges once, not per level
        hops = hops.repartition(*keys).persist(StorageLevel.MEMORY_AND_DISK)
        frontier = hops.select(F.col("node").alias("seed")).distinct().withColumn("node", F.col("seed"))
    else:
        frontier = seeds.select("seed").distinct().withColumn("node", F.col("seed"))

    columns = ["seed", "node", *attributes]
    schema = T.StructType(
        [
            T.StructField("seed", hops.schema["node"].dataType),
            T.StructField("node", hops.schema["_next"].dataType),
            *[T.StructField(a, hops.schema[a].dataType) for a in attributes],
            T.StructField("depth", T.IntegerType()),
        ]
    )
    levels = f"{path}/levels"
    for depth in range(1, max_depth + 1):
        current = fan_out(frontier, "node", hot) if salted else frontier
        level = current.join(hops, keys, "inner").drop("node").withColumnRenamed("_next", "node").select(*columns).distinct()
        level, rows = stage_counted(level, f"{levels}/depth={depth}")
        if rows == 0:
            break
        frontier = level.select("seed", "node").distinct()
    if seeds is None:
        hops.unpersist()
    base.unpersist()
    return spark.read.schema(schema).parquet(levels)


def _shortest(hops: DataFrame, seeds: DataFrame | None, max_depth: int, hot_rows: int, path: str) -> DataFrame:
    """(seed, node, depth) over hops (node, _next): levels of (node, block, bits), a bit for each seed that first reaches the node there."""
    spark = hops.sparkSession
    kinds = (hops.schema["node"].dataType, hops.schema["_next"].dataType)
    hops = hops.where("node <> _next")
    ends = hops.select(F.explode(F.array("node", "_next")).alias("name"))
    names = stage(ends.distinct().select("name", F.monotonically_increasing_id().alias("id")), f"{path}/names")
    coded = salted_join(hops, names.select(F.col("name").alias("node"), F.col("id").alias("a")), "node", "_next", hot_rows=hot_rows)
    coded = salted_join(coded.select("a", "_next"), names.select(F.col("name").alias("_next"), F.col("id").alias("b")), "_next", "a", hot_rows=hot_rows)
    coded = stage(coded.select(F.col("a").alias("node"), F.col("b").alias("_next")), f"{path}/edges")
    hot, hot_count = stage_counted(hot_keys(coded, "node", hot_rows), f"{path}/hot")
    salted = salt_rows(coded, "node", hot, spread_on="_next") if hot_count else coded
    keys = ["node", "_salt"] if hot_count else ["node"]
    starts = coded.select(F.col("node").alias("id")).distinct().join(names, "id") if seeds is None else seeds.select(F.col("seed").alias("name")).distinct().join(names, "name")
    asked = stage(starts.orderBy("id").select("name", "id", F.monotonically_increasing_id().alias("at")), f"{path}/asked")

    levels = f"{path}/levels"
    schema = "node long, block long, bits long, depth int"
    frontier = stage(asked.select(F.col("id").alias("node"), block("at").alias("block"), bit("at").alias("bits")), f"{levels}/depth=0")
    for depth in range(1, max_depth + 1):
        current = fan_out(frontier, "node", hot) if hot_count else frontier
        moved = grouped(current.join(salted, keys).select(F.col("_next").alias("node"), "block", "bits"), "node", "block")
        none = F.lit(None).cast("long")
        seen = spark.read.schema(schema).parquet(levels).where(F.col("depth") < depth).select("node", "block", none.alias("bits"), F.col("bits").alias("old"))
        both = moved.withColumn("old", none).unionByName(seen).groupBy("node", "block").agg(F.bit_or("bits").alias("new"), F.coalesce(F.bit_or("old"), F.lit(0).cast("long")).alias("old"))
        fresh = both.select("node", "block", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")
        frontier, rows = stage_counted(fresh, f"{levels}/depth={depth}")
        if rows == 0:
            break
    drop(spark, f"{path}/edges")
    reached = spark.read.schema(schema).parquet(levels).where("depth > 0")
    told = reached.join(names.select(F.col("id").alias("node"), "name"), "node").join(by_block(asked), "block")
    return told.select(named("bits", "names", "seed"), "name", "depth").select(F.col("seed").cast(kinds[0]).alias("seed"), F.col("name").cast(kinds[1]).alias("node"), "depth")


def upstream(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 5, **options) -> DataFrame:
    """Distinct ancestors of every seed with their least depth."""
    return traverse(edges, seeds, direction="upstream", max_depth=max_depth, **options)


def downstream(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 5, **options) -> DataFrame:
    """Distinct descendants of every seed with their least depth."""
    return traverse(edges, seeds, direction="downstream", max_depth=max_depth, **options)


def walked_edges(
    edges: DataFrame,
    reached: DataFrame,
    seeds: DataFrame,
    *,
    direction: str = "downstream",
    max_depth: int = 5,
    source: str = "source_urn",
    target: str = "target_urn",
) -> DataFrame:
    """The edges a traversal of ``max_depth`` hops used: (seed, *edge columns), distinct.

    An edge is used when the walk can stand at its near end with a hop left,
    that is at the seed or at a node reached in fewer than ``max_depth`` hops.
    """
    near = source if direction == "downstream" else target
    standing = reached.filter(F.col("depth") < max_depth).select("seed", F.col("node").alias(near))
    start = seeds.select("seed", F.col("seed").alias(near))
    return standing.unionByName(start).distinct().join(edges, near, "inner").distinct()


def trace_columns(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int = 5,
    source: str = "source_column_urn",
    target: str = "target_column_urn",
    index: LabelIndex | None = None,
) -> DataFrame:
    """Per seed and direction: how many nodes, walked edges, and the real greatest depth. With an ``index`` of the edges nothing is traversed."""
    edges = stage(edges.select(source, target).distinct(), new_stage(edges.sparkSession, "trace"))
    parts = []
    for direction in ("upstream", "downstream"):
        if index is None:
            reached = traverse(edges, seeds, direction=direction, max_depth=max_depth, source=source, target=target)
        else:
            reached = stage(reachable(index, seeds, direction, max_depth), new_stage(edges.sparkSession, "trace"))
        used = walked_edges(edges, reached, seeds, direction=direction, max_depth=max_depth, source=source, target=target)
        nodes = reached.groupBy("seed").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))
        walked = used.groupBy("seed").agg(F.count("*").alias("edges"))
        parts.append(nodes.join(walked, "seed", "left").withColumn("direction", F.lit(direction)))
    return parts[0].unionByName(parts[1])


def lineage_counts(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int = 5) -> DataFrame:
    """Both directions of every seed with real depth: (seed, direction, nodes, max_depth). For all nodes one walk is enough: the other is its transpose."""
    down = downstream(edges, seeds, max_depth)
    up = upstream(edges, seeds, max_depth) if seeds is not None else down.select(F.col("node").alias("seed"), F.col("seed").alias("node"), "depth")
    both = down.withColumn("direction", F.lit("downstream")).unionByName(up.withColumn("direction", F.lit("upstream")))
    return both.groupBy("seed", "direction").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))


def integrated_lineage(
    edges: DataFrame, task_edges: DataFrame, seeds: DataFrame, max_depth: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Capsules and tasks around each seed: (nodes, summary).

    nodes (seed, urn, node_type, role): the seed, its ancestors and descendants,
    and the tasks that produce or consume the seed; a node found in two roles
    keeps the first of root, upstream, downstream, producer, consumer.
    summary: one row per seed with the counts; ``seed`` is the asked node.
    """
    roots = seeds.select("seed", F.col("seed").alias("urn")).withColumn("role", F.lit("root"))
    up = upstream(edges, seeds, max_depth).select("seed", F.col("node").alias("urn")).withColumn("role", F.lit("upstream"))
    down = downstream(edges, seeds, max_depth).select("seed", F.col("node").alias("urn")).withColumn("role", F.lit("downstream"))
    around = task_edges.join(seeds.select(F.col("seed").alias("capsule_urn")).distinct(), "capsule_urn", "left_semi")
    role = F.when(F.col("edge_type") == "produces", "producer").when(F.col("edge_type") == "consumes", "consumer")
    tasks = around.select(F.col("capsule_urn").alias("seed"), F.col("task_urn").alias("urn"), role.alias("role")).filter(F.col("role").isNotNull())
    rank = {"root": 0, "upstream": 1, "downstream": 2, "producer": 3, "consumer": 4}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    nodes = (
        roots.unionByName(up).unionByName(down).unionByName(tasks)
        .groupBy("seed", "urn")
        .agg(F.min_by("role", order[F.col("role")]).alias("role"))
        .withColumn("node_type", F.when(F.col("role").isin("producer", "consumer"), "task").otherwise("capsule"))
    )
    summary = nodes.groupBy("seed").agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("node_type") == "capsule").alias("capsules"),
        F.count_if(F.col("node_type") == "task").alias("tasks"),
        F.count_if(F.col("role") == "upstream").alias("upstream"),
        F.count_if(F.col("role") == "downstream").alias("downstream"),
    )
    return nodes, summary


def direct_edges(edges: DataFrame, nodes: DataFrame, source: str = "source_urn", target: str = "target_urn") -> DataFrame:
    """Edges with either end in ``nodes`` (column ``urn``), each once.

    Two semi joins and a distinct union instead of an OR condition, which would
    become a nested loop.
    """
    out = edges.join(nodes.select(F.col("urn").alias(source)), source, "left_semi").select(*edges.columns)
    into = edges.join(nodes.select(F.col("urn").alias(target)), target, "left_semi").select(*edges.columns)
    return out.union(into).distinct()


def neighbour_edges(edges: DataFrame, nodes: DataFrame, source: str = "source_urn", target: str = "target_urn") -> DataFrame:
    """Direct edges of ``nodes`` (column ``urn``) as rows: ``urn``, its ``role`` (producer: the edge leads into it, consumer: out of it), the edge's columns."""
    wanted = nodes.select("urn").distinct()
    out = salted_join(edges.withColumn("urn", F.col(source)), wanted, "urn", target).withColumn("role", F.lit("consumer"))
    into = salted_join(edges.withColumn("urn", F.col(target)), wanted, "urn", source).withColumn("role", F.lit("producer"))
    return out.unionByName(into).select(*edges.columns, "role", "urn").distinct()


def subgraph(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, source: str = "source_urn", target: str = "target_urn") -> DataFrame:
    """The edges around each seed in both directions: (seed, *edge columns, direction); from the seed on, a walk keeps its direction."""
    edges = stage(edges.distinct(), new_stage(edges.sparkSession, "subgraph"))
    parts = []
    for direction in ("downstream", "upstream"):
        reached = traverse(edges, seeds, direction=direction, max_depth=max_depth, source=source, target=target)
        parts.append(walked_edges(edges, reached, seeds, direction=direction, max_depth=max_depth, source=source, target=target).withColumn("direction", F.lit(direction)))
    return parts[0].unionByName(parts[1])


def degrees(edges: DataFrame, source: str = "source_urn", target: str = "target_urn") -> DataFrame:
    """(urn, producers, consumers): direct in- and out-edge counts of every node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col(source).alias("urn"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col(target).alias("urn"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e")).select("e.*")
    return ends.groupBy("urn").agg(F.sum("i").alias("producers"), F.sum("o").alias("consumers"))


def transformations_into(column_edges: DataFrame) -> DataFrame:
    """Edges that carry transformation logic."""
    return column_edges.filter(F.col("transformation_logic").isNotNull()).select(
        "target_column_urn", "source_column_urn", "transformation_type", "transformation_logic", "confidence"
    )


def first_parents(edges: DataFrame, source: str = "source_urn", target: str = "target_urn") -> DataFrame:
    """(node, parent): the smallest source of every target."""
    return edges.groupBy(F.col(target).alias("node")).agg(F.min(source).alias("parent"))


def origins(
    edges: DataFrame, seeds: DataFrame, max_depth: int = 10, source: str = "source_urn", target: str = "target_urn", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(seed, origin, hops): follow the smallest upstream edge of each node.

    The walk ends at a node without upstream, before a node already on its own
    walk, or after ``max_depth`` hops; a seed without upstream gives no row.

    Pointer doubling: a node's next 2k ancestors are its next k and those of the
    last of them, so the number of joins is the logarithm of the depth. Many
    walks meet in one node: such nodes are split over tasks. On a walk nothing
    new follows a node met twice, so the distinct nodes of a trail are the walk.
    """
    spark = edges.sparkSession
    path = new_stage(spark, "origins")
    parents = first_parents(edges, source, target)
    step = stage(parents.select("node", F.array("parent").alias("trail")), f"{path}/trails=1")
    trails, length = {1: step}, 1

    def longer(walk: DataFrame, ahead: DataFrame, name: str) -> DataFrame:
        """Every walk (``name``, trail) goes on with the trail of its last node."""
        keyed = walk.withColumn("_last", F.coalesce(F.get("trail", F.size("trail") - 1), F.col(name)))
        more = ahead.select(F.col("node").alias("_last"), F.col("trail").alias("_more"))
        joined = salted_join(keyed, more, "_last", name, "left", hot_rows)
        return joined.select(name, F.concat("trail", F.coalesce("_more", F.array().cast(ahead.schema["trail"].dataType))).alias("trail"))

    complete = False
    while 2 * length <= max_depth and not complete:
        step, full = stage_counted(longer(step, step, "node"), f"{path}/trails={2 * length}", F.count_if(F.size("trail") == 2 * length))
        length *= 2
        trails[length] = step
        complete = full == 0  # no walk is as long as that: there is nothing further to join
    walk = seeds.select("seed").where("seed IS NOT NULL").distinct().withColumn("trail", F.array().cast(step.schema["trail"].dataType))
    for size in [length] if complete else [k for k in sorted(trails, reverse=True) if max_depth & k]:
        walk = stage(longer(walk, trails[size], "seed"), f"{path}/walks={size}")
    visited = F.array_distinct(F.concat(F.array("seed"), F.col("trail")))
    rows = walk.select("seed", visited.alias("visited"))
    return rows.where(F.size("visited") > 1).select("seed", F.element_at("visited", -1).alias("origin"), (F.size("visited") - 1).alias("hops"))


def terminals(
    edges: DataFrame, reached: DataFrame, max_depth: int = 10, source: str = "source_urn"
) -> DataFrame:
    """(seed, node, depth) of reached nodes without out-edges.

    Nodes first met at ``max_depth`` are not looked at, because the walk stops there.
    """
    starts = edges.select(F.col(source).alias("node")).distinct()
    return reached.filter(F.col("depth") < max_depth).join(starts, "node", "left_anti").select("seed", "node", "depth")


def task_order(task_edges: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Task-to-task edges of the given pipelines."""
    return task_edges.join(pipelines.select("pipeline_urn"), "pipeline_urn", "left_semi").select(
        "pipeline_urn", "source_task_urn", "target_task_urn"
    )
