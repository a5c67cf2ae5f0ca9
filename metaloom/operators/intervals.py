"""Points in intervals by hierarchical time bins: an as-of join without a range condition in its key.

Level l has bins of ``BASE`` * 4^l seconds. An interval belongs to the lowest level whose bins are at least as long as itself, so it
touches two bins at most, whatever its length; one without an end belongs to a level of its own with a single bin. A point looks into
one bin of each level that holds intervals. The join is on (key, level, bin), and what meets is checked exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 3600
#: the level of intervals without a begin or an end
OPEN = 99


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def _level(length: Column) -> Column:
    return F.greatest(F.ceil(F.log(4.0, F.greatest(length, F.lit(1)) / BASE)), F.lit(0)).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.when(level == OPEN, F.lit(0)).otherwise(F.floor(at / (F.lit(BASE) * F.pow(F.lit(4.0), level)))).cast("long")


def as_of(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each point with every interval of its key with start <= at < end: the columns of both sides.

    A null start or end is open; keys compare null-safe not at all (a null key meets nothing); an interval that ends
    at or before its start holds no point. The sides share no column names but the keys.
    """
    length = F.when(F.col(start).isNull() | F.col(end).isNull(), F.lit(None)).otherwise(_seconds(F.col(end)) - _seconds(F.col(start)))
    some = intervals.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(end) > F.col(start)))
    leveled = some.withColumn("_level", F.when(length.isNull(), F.lit(OPEN)).otherwise(_level(length)))
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # a few dozen at most
    first, last = _bin(_seconds(F.col(start)), F.col("_level")), _bin(_seconds(F.col(end)), F.col("_level"))
    placed = leveled.withColumn("_bin", F.explode(F.when(F.col("_level") == OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))))
    where = [F.struct(F.lit(k).alias("_level"), _bin(_seconds(F.col(at)), F.lit(k)).alias("_bin")) for k in levels]
    if not where:
        return points.join(intervals.limit(0), list(keys))
    looked = points.where(F.col(at).isNotNull()).withColumn("_p", F.explode(F.array(*where))).select(*points.columns, "_p._level", "_p._bin")
    # Spark takes a side for as small as it was before its rows were repeated for levels or bins, and would broadcast it
    met = looked.hint("merge").join(placed, [*keys, "_level", "_bin"])
    inside = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    rest = [c for c in intervals.columns if c not in keys]
    return met.where(inside).select(*points.columns, *rest)
