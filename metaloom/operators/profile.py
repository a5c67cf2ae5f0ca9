"""Column profiles: counts, statistics, frequent values, histograms, patterns.

Statistics of all columns come from one aggregate.  Value-level results share
``value_counts``, which combines map-side, so a frequent value never reaches
one task as rows.  Distinct counts and quantiles exist exact and approximate;
the exact quantiles never gather a column in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.operators.rollups import top_k_per_key

#: rows of a range of values that are put in order
MOST_INSIDE = 50_000


def _stacked(df: DataFrame, per_column: Mapping[str, Sequence[Column]]) -> DataFrame:
    """One aggregate over ``df``, one output row per column."""
    wide = df.agg(*[F.struct(F.lit(name).alias("column"), *fields).alias(f"c{i}") for i, (name, fields) in enumerate(per_column.items())])
    return wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(per_column))])).alias("c")).select("c.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-null values, as text, of all columns."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def count_profile(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Totals, nulls, distinct values and the quality scores of every column.

    ``exact=False`` estimates distinct counts in the same pass; ``exact=True``
    counts them from ``value_counts``.
    """
    total = F.count(F.lit(1))
    fields = {c: [total.alias("total_count"), (total - F.count(c)).alias("null_count"), F.approx_count_distinct(c).alias("distinct_count")] for c in columns}
    profile = _stacked(df, fields)
    if exact:
        distinct = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("exact_count"))
        profile = profile.join(F.broadcast(distinct), "column", "left").withColumn("distinct_count", F.coalesce("exact_count", F.lit(0))).drop("exact_count")
    share = lambda part: F.when(F.col("total_count") > 0, part / F.col("total_count") * 100).otherwise(0.0)
    return profile.withColumn("null_percentage", F.round(share(F.col("null_count")), 2)).withColumn("unique_percentage", F.round(share(F.col("distinct_count")), 2))


def scores(df: DataFrame, columns: Sequence[str], valid: Mapping[str, Column] | None = None, exact: bool = False) -> DataFrame:
    """Completeness, validity and uniqueness in percent, and their mean.

    Validity is the share of non-null values that meet the predicate given for
    the column; a column without predicate counts as valid.
    """
    valid = valid or {}
    counted = {c: [F.count(c).alias("filled"), F.count_if(F.col(c).isNotNull() & valid.get(c, F.lit(True))).alias("good")] for c in columns}
    rows = count_profile(df, columns, exact).join(F.broadcast(_stacked(df, counted)), "column")
    rows = rows.select(
        "column", F.round(100 - F.col("null_percentage"), 2).alias("completeness_score"),
        F.round(F.when(F.col("filled") > 0, F.col("good") / F.col("filled") * 100).otherwise(100.0), 2).alias("validity_score"),
        F.col("unique_percentage").alias("uniqueness_score"),
    )
    return rows.withColumn("overall_score", F.round((F.col("completeness_score") + F.col("validity_score") + F.col("uniqueness_score")) / 3, 4))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean, standard deviation and variance of every column in one pass."""
    fields = {
        c: [F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"), F.round(F.avg(c), 4).alias("mean_value"),
            F.round(F.stddev_samp(c), 4).alias("std_dev"), F.round(F.var_samp(c), 2).alias("variance")]
        for c in columns
    }
    return _stacked(df, fields)


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """(column, probability, value) from one mergeable sketch per column."""
    fields = {c: [F.percentile_approx(F.col(c).cast("double"), list(probabilities), accuracy).alias("v")] for c in columns}
    spread = _stacked(df, fields).select("column", F.posexplode("v").alias("i", "value"))
    return spread.select("column", F.array(*[F.lit(p) for p in probabilities])[F.col("i")].alias("probability"), "value")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 2_000, most: int = MOST_INSIDE) -> DataFrame:
    """(column, probability, value), linearly interpolated, without gathering or sorting a column.

    Rank selection by ranges: a sketch gives each wanted rank a range of values, counts say how many rows lie below the range
    and in it, and a range of more than ``most`` rows is sketched and cut again, 500 times smaller each time. Only the
    distinct values of the last ranges are put in order. The driver reads one row of bounds and counts per pass.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    margin = 2.0 / accuracy
    n = dict(zip(columns, df.agg(*[F.count(values[c]) for c in columns]).first(), strict=True))
    # each rank: its range [low, high], the rows below it and the rows in it; no bounds at first
    ranges = [{"column": c, "probability": float(p), "rank": p * (n[c] - 1), "low": None, "high": None, "below": 0, "inside": n[c]} for c in columns if n[c] for p in probabilities]

    def within(r: dict) -> Column:
        v = values[r["column"]]
        return v.isNotNull() if r["low"] is None else (v >= F.lit(r["low"])) & (v <= F.lit(r["high"]))

    while wide := [r for r in ranges if r["inside"] > most and (r["low"] is None or r["low"] < r["high"])]:
        edges = [[max(0.0, (int(r["rank"]) - r["below"]) / r["inside"] - margin), min(1.0, (int(r["rank"]) + 2 - r["below"]) / r["inside"] + margin)] for r in wide]
        cuts = df.agg(*[F.percentile_approx(F.when(within(r), values[r["column"]]), e, accuracy) for r, e in zip(wide, edges, strict=True)]).first()
        smaller = [r | {"low": low, "high": high} for r, (low, high) in zip(wide, cuts, strict=True)]
        counts = df.agg(*[x for r in smaller for x in (F.count_if(values[r["column"]] < F.lit(r["low"])), F.count_if(within(r)))]).first()
        for i, (r, new) in enumerate(zip(wide, smaller, strict=True)):
            below, inside = counts[2 * i], counts[2 * i + 1]
            holds = below <= int(r["rank"]) and min(int(r["rank"]) + 2, n[r["column"]]) <= below + inside
            if holds and inside < r["inside"]:
                r |= {"low": new["low"], "high": new["high"], "below": below, "inside": inside}
            else:  # many equal values: the range gets no smaller, and its distinct values are few
                r["inside"] = most
    spark = df.sparkSession
    kind = "column string, probability double, value double"
    if not ranges:
        return spark.createDataFrame([], kind)
    held = [F.when(within(r), F.struct(F.lit(i).alias("range"), values[r["column"]].alias("value"))) for i, r in enumerate(ranges)]
    counted = df.select(F.explode(F.array_compact(F.array(*held))).alias("h")).groupBy("h.range", "h.value").agg(F.count(F.lit(1)).alias("m"))
    wanted = spark.createDataFrame([(i, r["column"], r["probability"], int(r["rank"]), r["rank"] - int(r["rank"]), r["below"]) for i, r in enumerate(ranges)], "range int, column string, probability double, k long, fraction double, below long")
    upto = F.col("below") + F.sum("m").over(W.partitionBy("range").orderBy("value"))
    ordered = counted.join(F.broadcast(wanted), "range").withColumn("upto", upto)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
    found = ordered.groupBy("column", "probability", "fraction").agg(at(F.col("k")).alias("low"), at(F.col("k") + 1).alias("high"))
    return found.select("column", "probability", (F.col("low") + F.col("fraction") * (F.coalesce("high", "low") - F.col("low"))).alias("value"))


def length_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fields = {c: [F.min(F.length(c)).alias("min_length"), F.max(F.length(c)).alias("max_length"), F.round(F.avg(F.length(c)), 4).alias("avg_length")] for c in columns}
    return _stacked(df, fields)


def time_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fields = {c: [F.min(c).cast("timestamp_ntz").alias("earliest_timestamp"), F.max(c).cast("timestamp_ntz").alias("latest_timestamp")] for c in columns}
    return _stacked(df, fields)


def most_common(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, value, n, percentage, rank): the ``k`` most frequent values; ties by value."""
    filled = _stacked(df, {c: [F.count(c).alias("filled")] for c in columns})
    ranked = top_k_per_key(value_counts(df, columns), ["column"], [F.desc("n"), F.asc("value")], k)
    return ranked.join(F.broadcast(filled), "column").select("column", "value", "n", F.round(F.col("n") / F.col("filled") * 100, 4).alias("percentage"), "rank")


def histogram(df: DataFrame, columns: Sequence[str], buckets: int = 10) -> DataFrame:
    """(column, bucket, low, high, n): equal-width buckets between the extremes.

    The driver reads the extremes, one row, and they become literals.
    """
    extremes = df.agg(*[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)]).first()
    cells = []
    for i, c in enumerate(columns):
        low, high = extremes[f"a{i}"], extremes[f"b{i}"]
        if low is None:
            continue
        width = (high - low) / buckets if high > low else 1.0
        bucket = F.least(F.floor((F.col(c).cast("double") - low) / width), F.lit(buckets - 1)).cast("int")
        cells.append(F.when(F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("column"), bucket.alias("bucket"), F.round(low + bucket * F.lit(width), 6).alias("low"), F.round(low + (bucket + 1) * F.lit(width), 6).alias("high")
        )))
    rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    return rows.groupBy("column", "bucket", "low", "high").agg(F.count("*").alias("n"))


def pattern_of(value: Column) -> Column:
    """Shape of a text: runs of digits ``9``, of capitals ``A``, of small letters ``a``."""
    shaped = F.regexp_replace(value, "[0-9]+", "9")
    shaped = F.regexp_replace(shaped, "[A-Z]+", "A")
    return F.regexp_replace(shaped, "[a-z]+", "a")


def value_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, pattern, match_count): shapes of the values of every column."""
    counts = value_counts(df, columns)
    return counts.groupBy("column", pattern_of(F.col("value")).alias("pattern")).agg(F.sum("n").alias("match_count"))
