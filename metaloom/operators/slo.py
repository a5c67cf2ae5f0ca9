"""Service-level objectives of all data products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of the freshness target that warns, rules assumed per table
WARN_SHARE = 0.8
RULES_PER_TABLE = 10
QUALITY_MARGIN = 0.1
STATUS_RANK = {"passing": 1, "warning": 2, "failing": 3}


def freshness_status(hours: Column, target: Column) -> Column:
    """Null without target; warning without any update."""
    status = F.when(hours.isNull(), "warning").when(hours <= target * WARN_SHARE, "passing").when(hours <= target, "warning").otherwise("failing")
    return F.when(target.isNotNull() & (target != 0), status)


def quality_score(open_violations: Column, tables: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - open_violations / (tables * RULES_PER_TABLE)), 3)


def quality_status(score: Column, target: Column) -> Column:
    status = F.when(score.isNull(), "warning").when(score >= target, "passing").when(score >= target - QUALITY_MARGIN, "warning").otherwise("failing")
    return F.when(target.isNotNull() & (target != 0), status)


def availability_status(measured: Column, target: Column) -> Column:
    """Measured availability against its target; without a measure the check passes."""
    status = F.when(measured.isNull() | (measured >= target), "passing").otherwise("failing")
    return F.when(target.isNotNull() & (target != 0), status)


def availability(events: DataFrame, product: str, up: Column) -> DataFrame:
    """(product, availability): percentage of events that are not failures."""
    return events.groupBy(product).agg(F.round(F.avg(up.cast("int")) * 100, 4).alias("availability"))


def worst(*statuses: Column) -> Column:
    """The worst configured status; ``not_configured`` when none is."""
    rank = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    name = F.create_map(*[F.lit(x) for k, v in STATUS_RANK.items() for x in (v, k)])
    ranks = F.array_compact(F.array(*[F.when(s.isNotNull(), F.try_element_at(rank, s)) for s in statuses]))
    return F.coalesce(F.try_element_at(name, F.array_max(ranks)), F.lit("not_configured"))


def check_products(products: DataFrame, members: DataFrame, now: str, measured: DataFrame | None = None) -> DataFrame:
    """One row per product: every check and the overall status.

    products (product, slo_freshness_hours, slo_quality_threshold,
    slo_availability_percent); members (product, updated_at, open_violations),
    one row per table; measured (product, availability).
    """
    facts = members.groupBy("product").agg(F.count("*").alias("tables"), F.max("updated_at").alias("last_update"), F.sum("open_violations").alias("open_violations"))
    rows = products.join(facts, "product", "left")
    rows = rows.join(measured, "product", "left") if measured is not None else rows.withColumn("availability", F.lit(None).cast("double"))
    hours = (F.lit(now).cast("timestamp").cast("long") - F.col("last_update").cast("timestamp").cast("long")) / 3600
    score = quality_score(F.col("open_violations"), F.col("tables"))
    checked = rows.select(
        "product", F.round(hours, 2).alias("hours_since_update"), score.alias("quality_score"), "availability",
        freshness_status(hours, F.col("slo_freshness_hours")).alias("freshness"),
        quality_status(score, F.col("slo_quality_threshold")).alias("quality"),
        availability_status(F.col("availability"), F.col("slo_availability_percent")).alias("availability_status"),
    )
    return checked.withColumn("overall", worst(F.col("freshness"), F.col("quality"), F.col("availability_status")))
