"""Join helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of one join key that a single task should still take
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of ``df`` with more than ``hot_rows`` rows, and in how many parts of ``hot_rows`` rows they are cut.

    The count is combined map-side, so the shuffle carries one row per key and
    input partition.  At most ``rows / hot_rows`` keys come out; no broadcast
    hint is given, Spark decides from the measured size.
    """
    return (
        df.groupBy(F.col(key).alias("_hot_key"))
        .count()
        .filter(F.col("count") > hot_rows)
        .select("_hot_key", F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    )


def salt_rows(df: DataFrame, key: str, hot: DataFrame, spread_on: str) -> DataFrame:
    """Add ``_salt``: a hash bucket of ``spread_on`` for hot keys, 0 for all others."""
    joined = df.join(hot, df[key] == hot["_hot_key"], "left")
    salt = F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_on), F.col("_parts")).cast("int"))
    return joined.withColumn("_salt", salt).drop("_hot_key", "_parts")


def fan_out(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat the rows of hot keys once per salt, so each meets every salted row once."""
    joined = df.join(hot, df[key] == hot["_hot_key"], "left")
    buckets = F.when(F.col("_hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    return joined.withColumn("_salt", F.explode(buckets)).drop("_hot_key", "_parts")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_on: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` join ``right`` on ``key`` where the hot rows are on the left.

    Left rows of a hot key go to as many tasks as its count asks for, by a hash of
    ``spread_on``; the matching right rows are repeated for those keys only.  ``how`` may be inner,
    left, left_semi or left_anti; each left row still meets every right row of
    its key, so the result is that of the plain join.
    """
    hot = hot_keys(left, key, hot_rows)
    a = salt_rows(left, key, hot, spread_on)
    b = fan_out(right, key, hot)
    return a.join(b, [key, "_salt"], how).drop("_salt")
