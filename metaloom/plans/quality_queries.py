"""Profile, quality, masking, service-level, retention and schema-history queries."""

from pyspark.sql import functions as F

from metaloom.operators import governance, masking, profile, quality, rollups
from metaloom.plans.registry import Catalog, query
from metaloom.plans.views import NOW

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "orders": ["o_totalprice"], "events": ["value"]}


def union_sql(parts) -> str:
    return " UNION ALL ".join(parts)


@query("pr1_counts", union_sql(
    f"SELECT '{c}' AS \"column\", count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage, round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_percentage FROM lineitem" for c in LINEITEM))
def pr1_counts(c: Catalog):
    return profile.count_profile(c.table("lineitem"), LINEITEM, exact=True)


@query("pr1_counts_estimated")
def pr1_counts_estimated(c: Catalog):
    return profile.count_profile(c.table("orders"), c.table("orders").columns)


@query("pr2_statistics", union_sql(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value, "
    f"round(stddev_samp({c}), 4) AS std_dev, round(var_samp({c}), 2) AS variance FROM {t}" for t, cols in NUMERIC.items() for c in cols))
def pr2_statistics(c: Catalog):
    return quality.union_results(*[profile.numeric_profile(c.table(t), cols) for t, cols in NUMERIC.items()])


@query("pr2_quantiles", union_sql(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 6) AS value FROM {t}" for t, cols in NUMERIC.items() for c in cols for p in (0.25, 0.5, 0.75)))
def pr2_quantiles(c: Catalog):
    parts = [profile.exact_quantiles(c.table(t), cols) for t, cols in NUMERIC.items()]
    return quality.union_results(*parts).withColumn("value", F.round("value", 6))


@query("pr2_quantiles_estimated")
def pr2_quantiles_estimated(c: Catalog):
    return profile.approximate_quantiles(c.table("lineitem"), NUMERIC["lineitem"])


@query("pr3_lengths", union_sql(
    f"SELECT '{c}' AS \"column\", min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 4) AS avg_length FROM {t}"
    for t, c in (("documents", "text"), ("documents", "source"), ("conversations", "text"))))
def pr3_lengths(c: Catalog):
    return profile.length_profile(c.table("documents"), ["text", "source"]).unionByName(profile.length_profile(c.table("conversations"), ["text"]))


_TEXT_COLUMNS = {"orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type"], "documents": ["lang", "source"]}


@query("pr4_most_common", "SELECT * FROM (" + union_sql(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, round(count(*) / (SELECT count({c}) FROM {t}) * 100, 4) AS percentage, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {t} GROUP BY {c}"
    for t, cols in _TEXT_COLUMNS.items() for c in cols) + ") WHERE rank <= 5")
def pr4_most_common(c: Catalog):
    return quality.union_results(*[profile.most_common(c.table(t), cols, 5) for t, cols in _TEXT_COLUMNS.items()])


@query("pr5_histogram", union_sql(f"""
    SELECT '{c}' AS "column", b AS bucket, round(low + b * w, 6) AS low, round(low + (b + 1) * w, 6) AS high, count(*) AS n
    FROM (SELECT low, w, CAST(least(floor(({c} - low) / w), 9) AS INTEGER) AS b FROM {t}, (SELECT min({c}) AS low, (max({c}) - min({c})) / 10 AS w FROM {t}) WHERE {c} IS NOT NULL) GROUP BY 2, low, w"""
    for t, c in (("orders", "o_totalprice"), ("events", "value"), ("lineitem", "l_quantity"))))
def pr5_histogram(c: Catalog):
    return quality.union_results(profile.histogram(c.table("orders"), ["o_totalprice"]), profile.histogram(c.table("events"), ["value"]), profile.histogram(c.table("lineitem"), ["l_quantity"]))


@query("pr6_patterns", union_sql(f"""
    SELECT '{c}' AS "column", regexp_replace(regexp_replace(regexp_replace({c}, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g') AS pattern, count(*) AS match_count FROM {t} GROUP BY 2"""
    for t, c in (("orders", "o_orderpriority"), ("supplier", "s_name"), ("pages", "url"), ("part", "p_brand"))))
def pr6_patterns(c: Catalog):
    return quality.union_results(*[profile.value_patterns(c.table(t), [x]) for t, x in (("orders", "o_orderpriority"), ("supplier", "s_name"), ("pages", "url"), ("part", "p_brand"))])


@query("pr7_time_range", union_sql(f"SELECT '{c}' AS \"column\", min({c}) AS earliest_timestamp, max({c}) AS latest_timestamp FROM {t}" for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))))
def pr7_time_range(c: Catalog):
    return quality.union_results(*[profile.time_profile(c.table(t), [x]) for t, x in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))])


@query("pr8_scores", """
    WITH s AS (SELECT 'o_orderstatus' AS "column", 100.0::DOUBLE AS completeness_score, round(count(*) FILTER (o_orderstatus IN ('F', 'O')) / count(*) * 100, 2) AS validity_score, round(count(DISTINCT o_orderstatus) / count(*) * 100, 2) AS uniqueness_score FROM orders
      UNION ALL SELECT 'o_totalprice', 100.0, round(count(*) FILTER (o_totalprice < 400000) / count(*) * 100, 2), round(count(DISTINCT o_totalprice) / count(*) * 100, 2) FROM orders
      UNION ALL SELECT 'o_orderkey', 100.0, 100.0, round(count(DISTINCT o_orderkey) / count(*) * 100, 2) FROM orders)
    SELECT *, round((completeness_score + validity_score + uniqueness_score) / 3, 4) AS overall_score FROM s""")
def pr8_scores(c: Catalog):
    valid = {"o_orderstatus": F.col("o_orderstatus").isin("F", "O"), "o_totalprice": F.col("o_totalprice") < 400000}
    return profile.scores(c.table("orders"), ["o_orderstatus", "o_totalprice", "o_orderkey"], valid, exact=True)


# ---------------------------------------------------------------- quality

ORDER_RULES = [
    {"id": "q1", "rule_type": "not_null", "column": "o_custkey"},
    {"id": "q2", "rule_type": "no_empty_strings", "column": "o_orderpriority"},
    {"id": "q3", "rule_type": "completeness_threshold", "column": "o_totalprice", "threshold_percent": 99.0},
    {"id": "q4", "rule_type": "value_in_set", "column": "o_orderstatus", "config": {"allowed_values": ["F", "O"]}},
    {"id": "q5", "rule_type": "pattern_match", "column": "o_orderpriority", "config": {"pattern": "[1-4]-"}, "threshold_percent": 75.0},
    {"id": "q6", "rule_type": "format_valid", "column": "o_orderpriority", "config": {"pattern": "[1-5]-"}},
    {"id": "q7", "rule_type": "type_valid", "column": "o_orderpriority", "config": {"type": "int"}, "severity": "warning"},
    {"id": "q8", "rule_type": "range_check", "column": "o_totalprice", "config": {"min": 1000, "max": 450000}},
    {"id": "q9", "rule_type": "length_check", "column": "o_orderpriority", "config": {"min": 5, "max": 10}},
    {"id": "q10", "rule_type": "cross_field_validation", "config": {"expression": "o_orderstatus <> 'P' OR o_totalprice > 50000"}},
    {"id": "q11", "rule_type": "custom_sql", "config": {"expression": "o_totalprice >= 0"}},
    {"id": "q12", "rule_type": "custom_function", "config": {"function": "even", "columns": ["o_orderkey"]}, "severity": "info"},
]
_BAD = {
    "q1": "o_custkey IS NULL", "q2": "trim(o_orderpriority) = ''", "q3": "o_totalprice IS NULL", "q4": "o_orderstatus NOT IN ('F', 'O')",
    "q5": "NOT regexp_matches(o_orderpriority, '^(?:[1-4]-)')", "q6": "NOT regexp_matches(o_orderpriority, '^(?:[1-5]-)')",
    "q7": "TRY_CAST(o_orderpriority AS INTEGER) IS NULL", "q8": "NOT (o_totalprice BETWEEN 1000 AND 450000)", "q9": "NOT (length(o_orderpriority) BETWEEN 5 AND 10)",
    "q10": "NOT (o_orderstatus <> 'P' OR o_totalprice > 50000)", "q11": "NOT (o_totalprice >= 0)", "q12": "NOT (o_orderkey % 2 = 0)",
}
quality.register_function("even", lambda c: c % 2 == 0)


def _row_rule_sql(rule) -> str:
    limit, soft = rule.get("threshold_percent", 100.0), "warning" if rule.get("severity") in ("warning", "info") else "failed"
    return f"""SELECT '{rule['id']}' AS rule_id, '{rule['rule_type']}' AS rule_type, CASE WHEN (n - f) / n * 100 >= {limit} THEN 'passed' ELSE '{soft}' END AS check_status,
      round((n - f) / n * 100, 4) AS measured_value, n AS checked_count, f AS failure_count, round(f / n * 100, 4) AS failure_percentage
      FROM (SELECT count(*) AS n, count(*) FILTER ({_BAD[rule['id']]}) AS f FROM orders)"""


@query("dq1_row_rules", union_sql(_row_rule_sql(r) for r in ORDER_RULES))
def dq1_row_rules(c: Catalog):
    return quality.run_row_rules(c.table("orders"), ORDER_RULES)


@query("dq11_failing_rows", union_sql(f"SELECT '{k}' AS rule_id, o_orderkey FROM orders WHERE {v}" for k, v in _BAD.items()))
def dq11_failing_rows(c: Catalog):
    return quality.failing_rows(c.table("orders"), "o_orderkey", ORDER_RULES)


@query("dq11_sample_failures", "SELECT rule_id, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o_orderkey) AS rank FROM ("
       + union_sql(f"SELECT '{k}' AS rule_id, o_orderkey FROM orders WHERE {v}" for k, v in _BAD.items()) + ")) WHERE rank <= 5")
def dq11_sample_failures(c: Catalog):
    return quality.sample_failures(c.table("orders"), "o_orderkey", ORDER_RULES, 5)


def _set_sql(rule_id: str, kind: str, ok: str, measured: str, n: str, f: str, source: str) -> str:
    return f"""SELECT '{rule_id}' AS rule_id, '{kind}' AS rule_type, CASE WHEN {ok} THEN 'passed' ELSE 'failed' END AS check_status, round(CAST({measured} AS DOUBLE), 4) AS measured_value,
      CAST({n} AS BIGINT) AS checked_count, CAST({f} AS BIGINT) AS failure_count, round({f} / {n} * 100, 4) AS failure_percentage FROM ({source})"""


def _dup(key: str, table: str) -> str:
    return f"SELECT sum(n) AS n, coalesce(sum(n) FILTER (n > 1), 0) AS f FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"


@query("dq5_uniqueness", union_sql([
    _set_sql("u1", "unique", "f = 0", "f / n * 100", "n", "f", _dup("o_orderkey", "orders")),
    _set_sql("u2", "unique_combination", "f = 0", "f / n * 100", "n", "f", _dup("l_orderkey, l_linenumber", "lineitem")),
    _set_sql("u3", "duplicate_threshold", "f / n * 100 <= 10", "f / n * 100", "n", "f", _dup("text", "documents"))]))
def dq5_uniqueness(c: Catalog):
    return quality.union_results(
        quality.check_unique(c.table("orders"), "u1", ["o_orderkey"]),
        quality.check_unique(c.table("lineitem"), "u2", ["l_orderkey", "l_linenumber"], rule_type="unique_combination"),
        quality.check_unique(c.table("documents"), "u3", [quality.fingerprint("text")], 10.0, "duplicate_threshold"),
    )


@query("dq5_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq5_duplicate_keys(c: Catalog):
    return quality.duplicate_keys(c.table("lineitem"), ["l_orderkey", "l_linenumber"])


def _ref(child: str, key: str, parent: str, pk: str) -> str:
    return f"SELECT count({key}) AS n, count(*) FILTER ({key} NOT IN (SELECT {pk} FROM {parent})) AS f FROM {child}"


@query("dq6_references", union_sql([
    _set_sql("r1", "referential_integrity", "f = 0", "f", "n", "f", _ref("orders", "o_custkey", "customer", "c_custkey")),
    _set_sql("r2", "referential_integrity", "f = 0", "f", "n", "f", _ref("lineitem", "l_partkey", "part", "p_partkey")),
    _set_sql("r3", "referential_integrity", "f = 0", "f", "n", "f", _ref("orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 0)", "c_custkey"))]))
def dq6_references(c: Catalog):
    orders, customer = c.table("orders"), c.table("customer")
    return quality.union_results(
        quality.check_reference(orders, "r1", "o_custkey", customer, "c_custkey"),
        quality.check_reference(c.table("lineitem"), "r2", "l_partkey", c.table("part"), "p_partkey"),
        quality.check_reference(orders, "r3", "o_custkey", customer.filter("c_acctbal > 0"), "c_custkey"),
    )


@query("dq6_orphans", "SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY 1")
def dq6_orphans(c: Catalog):
    return quality.orphan_keys(c.table("orders"), "o_custkey", c.table("customer").filter("c_mktsegment <> 'MACHINERY'"), "c_custkey")


def _hours(column: str) -> str:
    return f"epoch(TIMESTAMP '{NOW}' - max({column})) / 3600"


@query("dq8_freshness", union_sql([
    _set_sql("f1", "freshness", "h <= 24 * 31", "h", "n", "CASE WHEN h <= 24 * 31 THEN 0 ELSE 1 END", f"SELECT {_hours('o_orderdate')} AS h, count(*) AS n FROM orders"),
    _set_sql("f2", "recency_check", "h <= 1", "h", "n", "CASE WHEN h <= 1 THEN 0 ELSE 1 END", f"SELECT {_hours('l_shipdate')} AS h, count(*) AS n FROM lineitem")]))
def dq8_freshness(c: Catalog):
    return quality.check_fresh(c.table("orders"), "f1", "o_orderdate", NOW, 24 * 31).unionByName(
        quality.check_fresh(c.table("lineitem"), "f2", "l_shipdate", NOW, 1, "recency_check"))


@query("dq9_distribution", union_sql([
    _set_sql("d1", "distribution_check", "abs(m - 25) <= 2.5 AND abs(s - 14.5) <= 1.45", "m", "n", "CASE WHEN abs(m - 25) <= 2.5 AND abs(s - 14.5) <= 1.45 THEN 0 ELSE 1 END", "SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(l_quantity) AS n FROM lineitem"),
    _set_sql("d2", "statistical_threshold", "v BETWEEN 0.04 AND 0.06", "v", "n", "CASE WHEN v BETWEEN 0.04 AND 0.06 THEN 0 ELSE 1 END", "SELECT avg(l_discount) AS v, count(*) AS n FROM lineitem")]))
def dq9_distribution(c: Catalog):
    lineitem = c.table("lineitem")
    return quality.check_distribution(lineitem, "d1", "l_quantity", 25.0, 14.5, 0.1).unionByName(
        quality.check_statistic(lineitem, "d2", F.avg("l_discount"), 0.04, 0.06))


_IQR = "SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}"


@query("dq9_outliers", union_sql([
    _set_sql("o1", "outlier_detection", "f / n * 100 <= 5", "f / n * 100", "n", "f", f"SELECT count(value) AS n, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS f FROM events, ({_IQR.format(c='value', t='events')})"),
    _set_sql("o2", "outlier_detection", "f / n * 100 <= 0.1", "f / n * 100", "n", "f", "SELECT count(value) AS n, count(*) FILTER (abs(value - m) > 3 * s) AS f FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)"),
    _set_sql("o3", "outlier_detection", "f / n * 100 <= 5", "f / n * 100", "n", "f", f"SELECT count(o_totalprice) AS n, count(*) FILTER (o_totalprice < a - 0.1 * (b - a) OR o_totalprice > b + 0.1 * (b - a)) AS f FROM orders, ({_IQR.format(c='o_totalprice', t='orders')})")]))
def dq9_outliers(c: Catalog):
    events = c.table("events")
    return quality.union_results(
        quality.check_outliers(events, "o1", "value"), quality.check_outliers(events, "o2", "value", "z_score", 3.0, 0.1),
        quality.check_outliers(c.table("orders"), "o3", "o_totalprice", sensitivity=0.1),
    )


@query("dq9_outlier_rows", f"SELECT event_id, value FROM events, ({_IQR.format(c='value', t='events')}) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def dq9_outlier_rows(c: Catalog):
    return quality.outliers(c.table("events"), "value").select("event_id", "value")


DOMAINS = {
    "enum": {"domain_type": "enum", "allowed_values": ["F", {"code": "O", "label": "open"}]},
    "pattern": {"domain_type": "pattern", "pattern_regex": "[12]-"}, "range": {"domain_type": "range", "min_value": 1000, "max_value": 400000},
}


@query("dq10_domains", union_sql([
    _set_sql("enum", "domain_enum", "f = 0", "f", "n", "f", "SELECT count(o_orderstatus) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS f FROM orders"),
    _set_sql("pattern", "domain_pattern", "f = 0", "f", "n", "f", "SELECT count(o_orderpriority) AS n, count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[12]-')) AS f FROM orders"),
    _set_sql("range", "domain_range", "f = 0", "f", "n", "f", "SELECT count(o_totalprice) AS n, count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 400000) AS f FROM orders"),
    _set_sql("reference", "referential_integrity", "f = 0", "f", "n", "f", _ref("supplier", "s_nationkey", "nation", "n_nationkey"))]))
def dq10_domains(c: Catalog):
    orders = c.table("orders")
    return quality.union_results(
        quality.check_domain(orders, "enum", "o_orderstatus", DOMAINS["enum"]), quality.check_domain(orders, "pattern", "o_orderpriority", DOMAINS["pattern"]),
        quality.check_domain(orders, "range", "o_totalprice", DOMAINS["range"]), quality.check_reference(c.table("supplier"), "reference", "s_nationkey", c.table("nation"), "n_nationkey"),
    )


@query("f22_domain_values", "SELECT DISTINCT o_orderstatus AS value, o_orderstatus IN ('F', 'O') AS valid FROM orders UNION ALL SELECT DISTINCT o_orderpriority, regexp_matches(o_orderpriority, '^[12]-') FROM orders")
def f22_domain_values(c: Catalog):
    orders = c.table("orders")
    status, priority = orders.select(F.col("o_orderstatus").alias("value")).distinct(), orders.select(F.col("o_orderpriority").alias("value")).distinct()
    return status.withColumn("valid", quality.in_domain(F.col("value"), DOMAINS["enum"])).unionByName(priority.withColumn("valid", quality.in_domain(F.col("value"), DOMAINS["pattern"])))


# ---------------------------------------------------------------- masking


@query("msk1_redaction", "SELECT c_custkey, '***' AS redacted, repeat('*', length(c_name)) AS same_length, concat(substr(c_name, 1, 3), repeat('*', length(c_name) - 7), right(c_name, 4)) AS partial FROM customer")
def msk1_redaction(c: Catalog):
    name = F.col("c_name")
    return c.table("customer").select("c_custkey", masking.redact(name).alias("redacted"), masking.redact(name, preserve_length=True).alias("same_length"), masking.partial_redact(name, 3, 4).alias("partial"))


@query("msk2_hashing", """
    SELECT c_custkey, sha256(concat('pepper', c_name)) AS hashed, concat('user_', substr(sha256(concat('pepper', c_name)), 1, 12)) AS pseudonym,
      (['alpha', 'beta', 'gamma'])[1 + CAST(concat('0x', substr(sha256(concat('pepper', c_name)), 1, 8)) AS BIGINT) % 3] AS substitute FROM customer""")
def msk2_hashing(c: Catalog):
    name = F.col("c_name")
    return c.table("customer").select("c_custkey", masking.hashed(name, "pepper").alias("hashed"), masking.pseudonym(name, salt="pepper").alias("pseudonym"), masking.substitute(name, ["alpha", "beta", "gamma"], "pepper").alias("substitute"))


@query("msk2_tokens", "SELECT DISTINCT c_mktsegment AS value, concat('tok_', substr(sha256(concat('pepper', c_mktsegment)), 1, 32)) AS token FROM customer")
def msk2_tokens(c: Catalog):
    return masking.token_table(c.table("customer"), "c_mktsegment", "pepper")


@query("msk2_detokenize", "SELECT c_custkey, c_mktsegment FROM customer")
def msk2_detokenize(c: Catalog):
    customer = c.table("customer").select("c_custkey", "c_mktsegment")
    tokens = masking.token_table(customer, "c_mktsegment", "pepper")
    hidden = masking.apply_rules(customer, [{"column": "c_mktsegment", "method": "tokenization", "config": {"salt": "pepper"}}])
    return masking.detokenize(hidden, "c_mktsegment", tokens, "c_custkey")


@query("msk3_encryption", "SELECT c_custkey, true AS hidden, c_name AS decrypted FROM customer")
def msk3_encryption(c: Catalog):
    key = F.lit("0123456789abcdef")
    rows = c.table("customer").withColumn("secret", masking.encrypt(F.col("c_name"), key))
    return rows.select("c_custkey", (F.col("secret") != F.col("c_name")).alias("hidden"), masking.decrypt(F.col("secret"), key).alias("decrypted"))


@query("msk4_generalization", "SELECT c_custkey, CAST(floor(c_acctbal / 1000) * 1000 AS DOUBLE) AS bucket, true AS noise_bounded FROM customer")
def msk4_generalization(c: Catalog):
    noisy = masking.add_noise(F.col("c_acctbal"), F.col("c_custkey"), 50.0, 7)
    return c.table("customer").select("c_custkey", masking.generalize(F.col("c_acctbal"), 1000).cast("double").alias("bucket"), (F.abs(noisy - F.col("c_acctbal")) <= 50.0001).alias("noise_bounded"))


MASKING_RULES = [
    {"column": "c_name", "method": "partial_redaction", "config": {"show_first": 1, "show_last": 2}, "roles": ["analyst"], "exempt_roles": ["admin"]},
    {"column": "c_acctbal", "method": "generalization", "config": {"bucket_size": 100}, "condition": "c_nationkey < 5", "preserve_type": True},
    {"column": "c_mktsegment", "method": "data_masking", "enabled": True},
    {"column": "c_custkey", "method": "hashing", "roles": ["developer"]},
]


@query("msk5_apply_rules", """
    SELECT c_custkey, concat(substr(c_name, 1, 1), repeat('*', length(c_name) - 3), right(c_name, 2)) AS c_name, c_nationkey,
      CASE WHEN c_nationkey < 5 THEN floor(c_acctbal / 100) * 100 ELSE c_acctbal END AS c_acctbal, regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g') AS c_mktsegment FROM customer""")
def msk5_apply_rules(c: Catalog):
    return masking.apply_rules(c.table("customer"), MASKING_RULES, role="analyst")


@query("msk5_mask_text", """
    SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\\p{Lu}', 'X', 'g'), '\\p{Ll}', 'x', 'g'), '\\p{Nd}', 'n', 'g')) AS masked_digest
    FROM documents""")
def msk5_mask_text(c: Catalog):
    return c.table("documents").select("doc_id", F.sha2(masking.mask_characters(F.col("text")), 256).alias("masked_digest"))


# ------------------------------------------------- service levels, history

_MEASURED = """m AS (SELECT concat('customer:', CAST(o_custkey AS STRING)) AS subject, max(o_orderdate) AS last_update, count(*) AS row_count,
      avg(CAST(o_orderstatus <> 'P' AS INTEGER)) AS completeness, avg(CAST(o_totalprice > 100000 AS INTEGER)) AS quality_score FROM orders GROUP BY 1)"""


@query("sla1_breaches", f"""
    WITH {_MEASURED}, f AS (SELECT c.*, m.* EXCLUDE (subject), epoch(TIMESTAMP '{NOW}' - last_update) / 3600 AS hours, coalesce(row_count, 0) AS rows FROM v_service_contracts c LEFT JOIN m USING (subject)),
    b AS (SELECT subject, 'freshness' AS incident_type, CAST(freshness_hours AS DOUBLE) AS sla_target, hours AS v FROM f WHERE hours > freshness_hours
      UNION ALL SELECT subject, 'row_count_low', CAST(row_count_min AS DOUBLE), rows FROM f WHERE rows < row_count_min
      UNION ALL SELECT subject, 'row_count_high', CAST(row_count_max AS DOUBLE), rows FROM f WHERE rows > row_count_max
      UNION ALL SELECT subject, 'completeness', completeness_sla, completeness FROM f WHERE completeness < completeness_sla
      UNION ALL SELECT subject, 'quality', quality_score_sla, quality_score FROM f WHERE quality_score < quality_score_sla),
    g AS (SELECT subject, incident_type, sla_target, round(v, 6) AS actual_value, round(abs(v - sla_target) / sla_target, 6) AS breach_magnitude FROM b)
    SELECT *, CASE WHEN breach_magnitude >= 0.5 THEN 'critical' WHEN breach_magnitude >= 0.25 THEN 'high' WHEN breach_magnitude >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM g""")
def sla1_breaches(c: Catalog):
    orders = c.table("orders").withColumn("subject", F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    measured = governance.measure(orders, "subject", "o_orderdate", F.col("o_orderstatus") != "P", F.col("o_totalprice") > 100000)
    return governance.breaches(c.view("v_service_contracts"), measured, NOW)


@query("ret1_past_retention", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 1825 DAY AND o_orderstatus <> 'P'")
def ret1_past_retention(c: Catalog):
    return governance.past_retention(c.table("orders"), "o_orderdate", NOW, 1825, F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderdate")


_CHANGES = """ch AS (SELECT coalesce(a.capsule_urn, b.capsule_urn) AS capsule_urn, coalesce(a.urn, b.urn) AS column_urn,
      CASE WHEN a.urn IS NULL THEN 'added' WHEN b.urn IS NULL THEN 'removed' ELSE 'retyped' END AS change
      FROM v_schema_old a FULL OUTER JOIN v_schema_new b ON a.urn = b.urn WHERE a.urn IS NULL OR b.urn IS NULL OR a.data_type <> b.data_type)"""


@query("ver1_schema_changes", f"WITH {_CHANGES} SELECT * FROM ch")
def ver1_schema_changes(c: Catalog):
    return governance.schema_changes(c.view("v_schema_old"), c.view("v_schema_new"))


@query("ver1_new_versions", f"""
    WITH {_CHANGES}, t AS (SELECT capsule_urn, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'retyped') AS y FROM ch GROUP BY 1)
    SELECT capsule_urn, coalesce((SELECT max(version_number) FROM v_versions v WHERE v.capsule_urn = t.capsule_urn), 0) + 1 AS version_number,
      CASE WHEN capsule_urn NOT IN (SELECT capsule_urn FROM v_schema_old) THEN 'created' WHEN capsule_urn NOT IN (SELECT capsule_urn FROM v_schema_new) THEN 'deleted' ELSE 'schema_change' END AS change_type,
      r > 0 OR y > 0 AS breaking_change, concat(a, ' added, ', r, ' removed, ', y, ' retyped') AS change_summary FROM t""")
def ver1_new_versions(c: Catalog):
    old, new = c.view("v_schema_old"), c.view("v_schema_new")
    return governance.new_versions(governance.schema_changes(old, new), c.view("v_versions"), old, new)


@query("ver2_current_schema", "SELECT capsule_urn, max(version_number) AS version_number FROM v_versions GROUP BY 1")
def ver2_current_schema(c: Catalog):
    return rollups.latest_per_key(c.view("v_versions").select("capsule_urn", "version_number"), ["capsule_urn"], "version_number")
