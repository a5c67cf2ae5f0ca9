"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns ``vnodes`` points on it; a key belongs to the next point
clockwise. Keys are placed in ring order, and a key whose shard is full continues clockwise to the next shard with
room. Since every shard has a bound and the bounds sum up to the load, balance is guaranteed, and only keys of the
overflowing arcs are moved.

Only counts per cell reach the driver: ``CELLS`` rows at any size. There the sweep turns them into at most
``CELLS + shards`` runs (cell, ranks) -> (shard, slots), which go back as a small table. Ranks come from one window per
cell over distinct keys; repeated keys are counted before they are ranked, so a key with a third of all rows is
one row there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom import staging

#: positions on the ring; fixes the size of everything that passes through the driver
CELLS = 4096
VNODES = 64


def _point(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "big") % CELLS


def ring(shards: int, vnodes: int = VNODES) -> list[list[int]]:
    """For every cell, the shards in the order in which they are met clockwise."""
    at: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            p = _point(s, v)
            while p in at:  # the next free cell
                p = (p + 1) % CELLS
            at[p] = s
    orders: list[list[int]] = []
    for cell in range(CELLS):
        seen: list[int] = []
        for step in range(CELLS):
            s = at.get((cell + step) % CELLS)
            if s is not None and s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        orders.append(seen)
    return orders


def sweep(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) of a clockwise sweep.

    ``slack`` is the share of the mean by which a shard may exceed it; 0 makes counts differ by one at most.
    """
    total = sum(counts.values())
    room = [int((total // shards) * (1 + slack)) + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs = []
    for cell, order in enumerate(ring(shards, vnodes)):
        rank, n = 0, counts.get(cell, 0)
        for s in order:
            take = min(n - rank, room[s] - used[s])
            if take > 0:
                runs.append((cell, rank, rank + take, s, used[s]))
                rank, used[s] = rank + take, used[s] + take
            if rank == n:
                break
    return runs


def place(rows: DataFrame, key: str, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``rows`` plus ``shard`` and ``slot`` (0, 1, ... in each shard).

    Rows that agree in all columns are interchangeable; a null key is a key like others; no rows give none.
    """
    names = rows.columns
    cell = F.pmod(F.xxhash64(F.lit("ring"), F.col(key)), F.lit(CELLS)).cast("int")
    spark = rows.sparkSession
    distinct = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_cell", cell)
    distinct = staging.stage(distinct, staging.new_stage(spark, "ring"))
    counts = {r["_cell"]: r["n"] for r in distinct.groupBy("_cell").agg(F.sum("_copies").alias("n")).collect()}  # CELLS rows at most
    runs = spark.createDataFrame(sweep(counts, shards, vnodes, slack), "_cell int, _first long, _end long, shard int, _slot long")

    order = [F.xxhash64(F.lit("rank"), F.col(key)), *(F.col(n) for n in names)]
    before = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("_from", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    # a distinct key may lie in several runs of its cell, and has its copies in each
    met = ranked.join(F.broadcast(runs), "_cell").where((F.col("_first") < F.col("_from") + F.col("_copies")) & (F.col("_from") < F.col("_end")))
    low = F.greatest("_first", "_from")
    high = F.least(F.col("_end"), F.col("_from") + F.col("_copies"))
    spread = met.withColumn("_rank", F.explode(F.sequence(low, high - 1)))
    return spread.select(*names, "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = VNODES) -> DataFrame:
    """Law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``).

    A null text has size 1 and checksum 0, an empty one as well. Further columns of ``docs`` play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return place(rows, "doc_id", shards, vnodes).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard."""
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).write.partitionBy("shard").parquet(path)
