"""Executors for declared data-quality rules.

All row-level rules of a table run in one aggregate scan.  Rules about sets
(uniqueness, references, outliers) reduce to one row per key before anything
is compared, so a hot key costs one combined row.  Every executor returns the
same result row: rule, status, measured value, failures.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.profile import exact_quantiles
from metaloom.operators.rollups import top_k_per_key

#: registered functions for ``custom_function`` rules: name -> Column builder
FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(name: str, fn: Callable[..., Column]) -> None:
    """Make ``fn`` (Columns in, boolean Column out; may wrap a pandas UDF) known to rules."""
    FUNCTIONS[name] = fn


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _within(c: Column, config: Mapping) -> Column:
    bounds = [c >= config["min"]] if config.get("min") is not None else []
    return _all(bounds + ([c <= config["max"]] if config.get("max") is not None else []))


def passes(rule: Mapping) -> Column:
    """The condition a good row meets.  Null values pass every rule but ``not_null``."""
    kind, config = rule["rule_type"], rule.get("config") or {}
    c = F.col(rule["column"]) if rule.get("column") else None
    if kind in ("not_null", "completeness_threshold"):
        return c.isNotNull()
    if kind == "no_empty_strings":
        ok = F.trim(c) != ""
    elif kind == "value_in_set":
        ok = c.isin(list(config["allowed_values"]))
    elif kind in ("pattern_match", "format_valid"):
        ok = c.rlike(f"^(?:{config['pattern']})")
    elif kind == "type_valid":
        ok = c.cast("string").try_cast(config["type"]).isNotNull()
    elif kind == "range_check":
        ok = _within(c, config)
    elif kind == "length_check":
        ok = _within(F.length(c), config)
    elif kind in ("cross_field_validation", "custom_sql"):
        ok = F.expr(config["expression"])
    elif kind == "custom_function":
        ok = FUNCTIONS[config["function"]](*[F.col(x) for x in config.get("columns") or [rule["column"]]])
    else:
        raise ValueError(f"not a row rule: {kind}")
    return F.coalesce(ok, F.lit(True))


def _result(rule_id: Column, rule_type: Column, status: Column, measured: Column, checked: Column, failures: Column) -> list[Column]:
    share = F.when(checked > 0, failures / checked * 100).otherwise(0.0)
    return [
        rule_id.alias("rule_id"), rule_type.alias("rule_type"), status.alias("check_status"), F.round(measured.cast("double"), 4).alias("measured_value"),
        checked.cast("long").alias("checked_count"), failures.cast("long").alias("failure_count"), F.round(share, 4).alias("failure_percentage"),
    ]


def run_row_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Results of all row-level rules in one scan.

    ``threshold_percent`` of a rule is the share of good rows it asks for (100
    by default); a rule of severity ``warning`` or ``info`` warns instead of failing.
    """
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~passes(r)).alias(f"f{i}") for i, r in enumerate(rules)])
    cells = []
    for i, rule in enumerate(rules):
        good = F.when(F.col("n") > 0, (F.col("n") - F.col(f"f{i}")) / F.col("n") * 100).otherwise(100.0)
        failed = "warning" if rule.get("severity", "error") in ("warning", "info") else "failed"
        status = F.when(good >= float(rule.get("threshold_percent", 100.0)), "passed").otherwise(failed)
        cells.append(F.struct(*_result(F.lit(rule["id"]), F.lit(rule["rule_type"]), status, good, F.col("n"), F.col(f"f{i}"))))
    return counts.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def failing_rows(df: DataFrame, key: str, rules: Sequence[Mapping]) -> DataFrame:
    """(rule_id, key) of every failing row, all rules in one scan."""
    names = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r["id"])) for r in rules]))
    return df.select(F.explode(names).alias("rule_id"), F.col(key))


def sample_failures(df: DataFrame, key: str, rules: Sequence[Mapping], k: int = 10) -> DataFrame:
    """The ``k`` failing keys of each rule that sort first."""
    return top_k_per_key(failing_rows(df, key, rules), ["rule_id"], [F.asc(key)], k)


def _one(df: DataFrame, rule_id: str, rule_type: str, ok: Column, measured: Column, checked: Column, failures: Column) -> DataFrame:
    return df.select(*_result(F.lit(rule_id), F.lit(rule_type), F.when(ok, "passed").otherwise("failed"), measured, checked, failures))


def fingerprint(c: str) -> Column:
    """SHA-256 of a long text, so that grouping shuffles 64 characters, not the text."""
    return F.sha2(F.col(c), 256)


def duplicate_keys(df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    """Key combinations that occur more than once, with their count ``n``."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_unique(df: DataFrame, rule_id: str, columns: Sequence[Column | str], max_duplicate_percent: float = 0.0, rule_type: str = "unique") -> DataFrame:
    """Failures are the rows whose key occurs more than once; measured is their share."""
    per_key = df.groupBy(*columns).agg(F.count("*").alias("n"))
    totals = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("f"))
    share = F.when(F.col("n") > 0, F.col("f") / F.col("n") * 100).otherwise(0.0)
    return _one(totals, rule_id, rule_type, share <= max_duplicate_percent, share, F.col("n"), F.col("f"))


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): child key values without a parent; the child is reduced to one row per key first."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("n"))
    return keys.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def check_reference(child: DataFrame, rule_id: str, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    total = child.agg(F.count(child_key).alias("n"), F.lit(1).alias("_k"))
    failed = orphan_keys(child, child_key, parent, parent_key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f"), F.lit(1).alias("_k"))
    return _one(total.join(failed, "_k"), rule_id, "referential_integrity", F.col("f") == 0, F.col("f"), F.col("n"), F.col("f"))


def check_fresh(df: DataFrame, rule_id: str, column: str, now: str, max_hours: float, rule_type: str = "freshness") -> DataFrame:
    """Hours between the newest value and ``now``."""
    seconds = F.lit(now).cast("timestamp").cast("long") - F.max(F.col(column).cast("timestamp")).cast("long")
    aged = df.agg((seconds / 3600).alias("hours"), F.count(F.lit(1)).alias("n"))
    ok = F.coalesce(F.col("hours") <= max_hours, F.lit(False))
    return _one(aged, rule_id, rule_type, ok, F.col("hours"), F.col("n"), F.when(ok, 0).otherwise(1))


def check_distribution(df: DataFrame, rule_id: str, column: str, mean: float, std_dev: float, tolerance: float) -> DataFrame:
    """Mean and deviation within a relative tolerance of the expected ones."""
    found = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(column).alias("n"))
    ok = (F.abs(F.col("m") - mean) <= abs(mean) * tolerance) & (F.abs(F.col("s") - std_dev) <= std_dev * tolerance)
    return _one(found, rule_id, "distribution_check", ok, F.col("m"), F.col("n"), F.when(ok, 0).otherwise(1))


def check_statistic(df: DataFrame, rule_id: str, statistic: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """An aggregate (``F.avg``, ``F.sum`` …) between two bounds."""
    found = df.agg(statistic.alias("v"), F.count(F.lit(1)).alias("n"))
    ok = _within(F.col("v"), {"min": low, "max": high})
    return _one(found, rule_id, "statistical_threshold", ok, F.col("v"), F.col("n"), F.when(ok, 0).otherwise(1))


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", sensitivity: float = 1.5) -> tuple[float, float] | None:
    """The values beyond which a row is an outlier (two numbers on the driver)."""
    if method == "iqr":
        q = {r["probability"]: r["value"] for r in exact_quantiles(df, [column], (0.25, 0.75)).collect()}
        if not q:
            return None
        spread = q[0.75] - q[0.25]
        return q[0.25] - sensitivity * spread, q[0.75] + sensitivity * spread
    if method == "z_score":
        m, s = df.agg(F.avg(column), F.stddev_samp(column)).first()
        return None if m is None or s is None else (m - sensitivity * s, m + sensitivity * s)
    raise ValueError(f"unknown method {method}")


def outliers(df: DataFrame, column: str, method: str = "iqr", sensitivity: float = 1.5) -> DataFrame:
    """Rows outside the bounds."""
    bounds = outlier_bounds(df, column, method, sensitivity)
    return df.filter(F.lit(False)) if bounds is None else df.filter((F.col(column) < bounds[0]) | (F.col(column) > bounds[1]))


def check_outliers(df: DataFrame, rule_id: str, column: str, method: str = "iqr", sensitivity: float = 1.5, max_outlier_percent: float = 5.0) -> DataFrame:
    bounds = outlier_bounds(df, column, method, sensitivity)
    outside = F.lit(False) if bounds is None else (F.col(column) < bounds[0]) | (F.col(column) > bounds[1])
    found = df.agg(F.count(column).alias("n"), F.count_if(outside).alias("f"))
    share = F.when(F.col("n") > 0, F.col("f") / F.col("n") * 100).otherwise(0.0)
    return _one(found, rule_id, "outlier_detection", share <= max_outlier_percent, share, F.col("n"), F.col("f"))


def in_domain(value: Column, domain: Mapping) -> Column:
    """Value-domain test: enum (text or {code}), pattern anchored at the start, range.

    ``reference_data`` needs a join: use ``check_reference``.
    """
    kind = domain["domain_type"]
    if kind == "enum" and domain.get("allowed_values"):
        return value.isin([v if isinstance(v, str) else v.get("code") for v in domain["allowed_values"]])
    if kind == "pattern" and domain.get("pattern_regex"):
        return value.rlike(f"^(?:{domain['pattern_regex']})")
    if kind == "range":
        return _within(value, {"min": domain.get("min_value"), "max": domain.get("max_value")})
    return F.lit(True)


def check_domain(df: DataFrame, rule_id: str, column: str, domain: Mapping) -> DataFrame:
    bad = F.coalesce(~in_domain(F.col(column), domain), F.lit(False))
    found = df.agg(F.count(column).alias("n"), F.count_if(bad).alias("f"))
    return _one(found, rule_id, f"domain_{domain['domain_type']}", F.col("f") == 0, F.col("f"), F.col("n"), F.col("f"))


def union_results(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)
