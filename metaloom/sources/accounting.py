"""Row accounting of sources: nothing that is read disappears unseen.

``account`` writes a list once. While it is written, an Observation counts the rows that come in, go on and are dropped; a
dropped row becomes a problem with severity, location and message. For every list, rows in = rows out + problems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from metaloom.staging import new_stage, stage

PROBLEMS = ["list", "severity", "location", "message"]


@dataclass(frozen=True)
class Accounted:
    """kept: the rows without a problem; problems: (list, severity, location, message); counts: (list, rows_in, rows_out, dropped), one row."""

    kept: DataFrame
    problems: DataFrame
    counts: DataFrame


def account(rows: DataFrame, name: str, checks: Sequence[tuple[Column, str, str]], location: Column) -> Accounted:
    """Rows that fail a check (condition that must hold, severity, message) are dropped; the first failed one is reported. A null condition fails."""
    spark = rows.sparkSession
    failed = F.lit(None).cast("struct<severity:string,message:string>")
    for holds, severity, message in reversed(checks):
        failed = F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))).otherwise(failed)
    seen = Observation()
    marked = rows.select(*rows.columns, failed.alias("_failed"), F.coalesce(location.cast("string"), F.lit("")).alias("_location"))
    dropped = F.col("_failed").isNotNull()
    observed = marked.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(~dropped).alias("rows_out"), F.count_if(dropped).alias("dropped"))
    written = stage(observed, new_stage(spark, f"list-{name}"))
    n = seen.get
    return Accounted(
        written.where(~dropped).select(*rows.columns),
        written.where(dropped).select(F.lit(name).alias("list"), "_failed.severity", F.col("_location").alias("location"), "_failed.message"),
        spark.createDataFrame([(name, n["rows_in"], n["rows_out"], n["dropped"])], "list string, rows_in long, rows_out long, dropped long"),
    )


def problem_rows(accounts: Sequence[Accounted]) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.problems for a in accounts])


def list_counts(accounts: Sequence[Accounted]) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.counts for a in accounts])


def severities(accounts: Sequence[Accounted]) -> DataFrame:
    """(severity, n) over all lists."""
    return problem_rows(accounts).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
