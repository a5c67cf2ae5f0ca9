"""Expected values of the classification, schedule, quality and masking expressions."""

import random

import pytest
from pyspark.sql import functions as F

from metaloom.functions import classify, schedule
from metaloom.operators import conformance, masking, pii, profile, quality


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema).select("_i", column.alias("v")).orderBy("_i").select("v").collect()]


def test_detect_pii_order(spark):
    rows = [
        ("note", {"pii": "true", "pii_type": "email"}, []), ("note", {"pii": "true"}, []), ("note", {"pii": "phone"}, []), ("note", {"sensitive": "true"}, ["pii:ssn"]), ("note", {}, ["x", "PII:SSN"]),
        ("note", {}, ["PII"]), ("user_email", {}, []), ("EMAIL_HASH", {}, []), ("first_name", {"pii": "false"}, []), ("amount", {}, []), ("name", {}, None),
    ]
    got = values(spark, rows, "name string, meta map<string,string>, tags array<string>", classify.detect_pii(F.col("name"), F.col("meta"), F.col("tags")))
    assert [tuple(g) for g in got] == [
        ("email", "tag"), ("unknown", "tag"), ("phone", "tag"), ("sensitive", "tag"), ("ssn", "tag"), ("unknown", "tag"), ("email", "pattern"), ("email", "pattern"), ("name", "pattern"), (None, None), (None, None),
    ]


def test_layers_and_domains(spark):
    rows = [("stg_x", "models/a.sql", [], {}), ("x", "models/marts/x.sql", [], {}), ("dim_x", "", ["Raw"], {}), ("x", "", [], {"layer": "GOLD"}), ("x", "", [], {})]
    schema = "name string, path string, tags array<string>, meta map<string,string>"
    assert values(spark, rows, schema, classify.infer_layer(F.col("name"), F.col("path"), F.col("tags"), F.col("meta"))) == ["silver", "gold", "bronze", "gold", None]
    rows = [("x", "models/staging/sales/x.sql", [], {}), ("x", "models/core/_tmp/x.sql", [], {}), ("x", "a/b2/x.sql", ["domain:Ops"], {}), ("x", "a/b2/x.sql", [], {"domain": "HR"}), ("x", "a/b2/x.sql", [], {})]
    assert values(spark, rows, schema, classify.infer_domain(F.col("path"), F.col("tags"), F.col("meta"))) == ["sales", None, "ops", "hr", "a"]


def test_exposures_say_what_is_exposed_and_what_to_do(spark):
    rows = [("u1", "user_email", "email", "Gold"), ("u2", "home_phone", "phone", "marts"), ("u3", "email_hash", "email", "gold"), ("u4", "user_email", "email", "silver"), ("u5", "ssn", "ssn", None)]
    found = spark.createDataFrame([(*r, "c", "t") for r in rows], "urn string, name string, pii_type string, layer string, capsule_urn string, capsule_name string")
    assert {(r.column_urn, r.reason, r.recommendation) for r in pii.exposures(found).collect()} == {
        ("u1", "Unmasked email PII in gold layer", "Apply masking, hashing, or encryption to user_email"), ("u2", "Unmasked phone PII in marts layer", "Apply masking, hashing, or encryption to home_phone"),
    }


def test_semantic_types(spark):
    names = ["customer_id", "id", "order_sk_key", "natural_key", "created_at", "total", "x_pk", "note"]
    got = values(spark, [(n, None) for n in names], "name string, pii string", classify.semantic_type(F.col("name"), F.col("pii")))
    assert got == ["foreign_key", "surrogate_key", "surrogate_key", "business_key", "timestamp", "metric", "surrogate_key", None]


def test_expressions(spark):
    texts = ["a.b", "cast(a as int)", "a::int", "sum(a)", "sum(a) + sum(b)", "upper(x)", "date_trunc('day', ts)", "case when a then b else c + 1 end", "(select max(a) from t)", "my_fn(a - b)", "'a-b'"]
    got = values(spark, [(t,) for t in texts], "e string", classify.transformation_of(F.col("e")))
    assert [g[0] for g in got] == ["identity", "cast", "cast", "aggregate", "arithmetic", "string_transform", "date_transform", "conditional", "subquery", "formula", "formula"]


def test_cron(spark):
    crons = ["* * * * *", "5 * * * *", "0 */6 * * *", "0,30 2,14 * * *", "* 3 * * *", "bad", "0 0 31 12 *", "0 9 13 * 5"]
    c = F.col("c")
    assert values(spark, [(x,) for x in crons], "c string", schedule.runs_per_day(c)) == [1440.0, 24.0, 1.0, 4.0, 1.0, 1.0, 1.0, 1.0]
    assert values(spark, [(x,) for x in crons], "c string", schedule.hours_of(c)) == [list(range(24)), list(range(24)), [0, 6, 12, 18], [2, 14], [3], [], [0], [9]]
    next_runs = values(spark, [(x,) for x in crons], "c string", F.date_format(schedule.next_run(c, "2001-09-01 10:20:00"), "yyyy-MM-dd HH:mm"))
    assert next_runs == ["2001-09-01 10:21", "2001-09-01 11:05", "2001-09-01 12:00", "2001-09-01 14:00", "2001-09-02 03:00", None, "2001-12-31 00:00", "2001-09-07 09:00"]
    assert values(spark, [("@daily",), ("@once",), ("None",), ("1 2 3 4 5",)], "c string", schedule.cron_of(c)) == ["0 0 * * *", None, None, "1 2 3 4 5"]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    r = random.Random(1)
    data = [r.gauss(0, 100) if i % 3 else 5.0 for i in range(997)] + [None]
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(5)
    got = {q.probability: q.value for q in profile.exact_quantiles(df, ["x"], (0.1, 0.25, 0.5, 0.75, 0.99), accuracy).collect()}
    ordered = sorted(x for x in data if x is not None)
    for p, v in got.items():
        k = p * (len(ordered) - 1)
        low = ordered[int(k)]
        want = low + (k - int(k)) * (ordered[min(int(k) + 1, len(ordered) - 1)] - low)
        assert abs(v - want) < 1e-9


def test_quality_nulls_and_thresholds(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "b")], "id int, v string")
    rules = [{"id": "a", "rule_type": "not_null", "column": "v", "threshold_percent": 70}, {"id": "b", "rule_type": "no_empty_strings", "column": "v"}, {"id": "c", "rule_type": "value_in_set", "column": "v", "config": {"allowed_values": ["a", "", "b"]}}]
    got = {r.rule_id: (r.check_status, r.failure_count) for r in quality.run_row_rules(df, rules).collect()}
    assert got == {"a": ("passed", 1), "b": ("failed", 1), "c": ("passed", 0)}
    empty = df.filter("false")
    assert [r.check_status for r in quality.run_row_rules(empty, rules).collect()] == ["passed"] * 3


def test_masking(spark):
    c = F.col("v")
    assert values(spark, [("4111111111111111",), ("abc",), (None,)], "v string", masking.partial_redact(c, 3, 4)) == ["411*********1111", "***", None]
    key = F.lit("0123456789abcdef")
    assert values(spark, [("secret",)], "v string", masking.decrypt(masking.encrypt(c, key), key)) == ["secret"]
    df = spark.createDataFrame([(1, "a", None)], "id int, v string, w string")
    rules = [{"column": "v", "method": "redaction", "roles": ["analyst"], "exempt_roles": ["boss"]}, {"column": "w", "method": "hashing"}]
    assert masking.apply_rules(df, rules, "analyst").first().v == "***"
    assert masking.apply_rules(df, rules, "boss").first().v == "a"
    assert masking.apply_rules(df, rules, "analyst").first().w is None


def test_custom_rules_are_checked(spark):
    good = {"id": "X", "name": "n", "description": "d", "severity": "Warning", "category": "naming", "scope": "capsule", "pattern": "dim_"}
    assert conformance.custom_rule(good).severity == "warning"
    for broken in ({**good, "severity": "bad"}, {**good, "scope": "table"}, {k: v for k, v in good.items() if k != "name"}):
        with pytest.raises(ValueError):
            conformance.custom_rule(broken)
    assert len({r[0] for listed in conformance.RULES.values() for r in listed}) == 60
