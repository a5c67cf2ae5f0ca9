"""Execution timelines: frequency, peak hours, quiet and busy windows.

Every operator takes one row per scheduled task with a group column and
returns rows per group, for all groups at once.  Hours are counted before they
are windowed, so a window never holds more than 24 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaloom.functions.schedule import cron_of, hours_of, next_run, period_of, runs_per_day

# Gap length, share of the peak, windows reported, durations
MIN_GAP_HOURS = 4
PEAK_SHARE = 0.8
MAX_WINDOWS = 3
DEFAULT_DURATION_SECONDS = 300
DEFAULT_RISK = 50


def schedules(tasks: DataFrame, schedule: str = "schedule_interval") -> DataFrame:
    """Scheduled tasks with ``cron``, ``runs_per_day`` and ``hours``."""
    cron = cron_of(F.col(schedule))
    return tasks.withColumn("cron", cron).filter(F.col("cron").isNotNull()).withColumns({"runs_per_day": runs_per_day(F.col("cron")), "hours": hours_of(F.col("cron"))})


def hour_counts(scheduled: DataFrame, group: str) -> DataFrame:
    """(group, hour, tasks)"""
    return scheduled.select(group, F.explode("hours").alias("hour")).groupBy(group, "hour").agg(F.count("*").alias("tasks"))


def frequency(scheduled: DataFrame, group: str) -> DataFrame:
    """Runs per day and week, and a label of the total frequency."""
    total = F.sum("runs_per_day")
    label = (
        F.when(total >= 24, "hourly").when(total >= 7, "several_a_day").when(total >= 1, "daily").when(total >= 0.5, "some_days").otherwise("rare")
    )
    return scheduled.groupBy(group).agg(total.alias("executions_per_day"), (total * 7).alias("executions_per_week"), label.alias("schedule_pattern"))


def peak_hours(scheduled: DataFrame, group: str) -> DataFrame:
    """(group, hour, tasks) of the hours with at least the mean count of busy hours."""
    counts = hour_counts(scheduled, group)
    return counts.withColumn("mean", F.avg("tasks").over(W.partitionBy(group))).filter(F.col("tasks") >= F.col("mean")).drop("mean")


def _runs(hours: DataFrame, group: str, *extra: Column) -> DataFrame:
    """Consecutive hours as (group, start_hour, end_hour, rank); the end is exclusive."""
    island = F.col("hour") - F.row_number().over(W.partitionBy(group).orderBy("hour"))
    runs = hours.withColumn("_run", island).groupBy(group, "_run").agg(F.min("hour").alias("start_hour"), (F.max("hour") + 1).alias("end_hour"), *extra)
    return runs.drop("_run")


def _first(windows: DataFrame, group: str) -> DataFrame:
    ranked = windows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("start_hour")))
    return ranked.filter(F.col("rank") <= MAX_WINDOWS)


def quiet_windows(scheduled: DataFrame, group: str) -> DataFrame:
    """The first three gaps of four or more hours without any run."""
    every = scheduled.select(group).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    idle = every.join(hour_counts(scheduled, group), [group, "hour"], "left_anti")
    length = F.col("end_hour") - F.col("start_hour")
    gaps = _runs(idle, group).filter(length >= MIN_GAP_HOURS)
    return _first(gaps, group).select(group, "start_hour", "end_hour", "rank", F.lit(0.1).alias("impact_score"), F.lit("idle").alias("reason"), length.cast("long").alias("idle_hours"))


def busy_windows(scheduled: DataFrame, group: str) -> DataFrame:
    """The first three runs of hours at 80 % of the greatest count or more."""
    counts = hour_counts(scheduled, group).withColumn("most", F.max("tasks").over(W.partitionBy(group)))
    runs = _runs(counts.filter(F.col("tasks") >= F.col("most") * PEAK_SHARE), group, F.max("most").alias("most"))
    return _first(runs, group).select(group, "start_hour", "end_hour", "rank", F.lit(0.9).alias("impact_score"), F.lit("busy").alias("reason"), F.col("most").alias("most_tasks"))


def best_window(scheduled: DataFrame, group: str) -> DataFrame:
    """The first quiet window of each group."""
    return quiet_windows(scheduled, group).filter(F.col("rank") == 1).drop("rank")


def downtime(tasks: DataFrame, group: str, duration: str, risk: str) -> DataFrame:
    """Estimated minutes of downtime: durations weighted by risk, with defaults."""
    seconds = F.when(F.col(duration) > 0, F.col(duration)).otherwise(DEFAULT_DURATION_SECONDS)
    score = F.when(F.col(risk) != 0, F.col(risk)).otherwise(DEFAULT_RISK)
    return tasks.groupBy(group).agg(F.round(F.sum(seconds / 60 * (1 + score / 100)), 2).alias("estimated_downtime_minutes"))


def periods(scheduled: DataFrame, group: str) -> DataFrame:
    """(group, period, runs) by time of day."""
    counts = hour_counts(scheduled, group)
    return counts.groupBy(group, period_of(F.col("hour")).alias("period")).agg(F.sum("tasks").alias("runs"))


def next_runs(scheduled: DataFrame, group: str, now: str) -> DataFrame:
    """(group, next_execution): earliest next run; each distinct cron is worked out once."""
    crons = scheduled.select("cron").distinct().withColumn("next_execution", next_run(F.col("cron"), now))
    return scheduled.select(group, "cron").join(crons, "cron").groupBy(group).agg(F.min("next_execution").alias("next_execution"))
