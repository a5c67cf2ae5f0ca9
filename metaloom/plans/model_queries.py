"""Queries over the catalog's own rows: flags of each family, versions as of a time, bridges, footprints, whole reports."""

from pyspark.sql import functions as F

from metaloom.operators import conformance as cf
from metaloom.operators import filters, flags, intervals, pii, rollups, substring_index
from metaloom.plans import conformance_queries as cq
from metaloom.plans.export_queries import _NODE_SQL, nodes
from metaloom.plans.pii_queries import PII_SQL
from metaloom.plans.registry import Catalog, query
from metaloom.sinks import export
from metaloom.sources import manifest

TODAY = "2001-09-01"


def _met(df, key: str, family: flags.Flags):
    return filters.matches(df, key, family)


def _flag_sql(view: str, key: str, cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS filter FROM {view} WHERE {sql}" for name, sql in cases.items())


# ------------------------------------------------------------- families of flags


@query("flt26_column_flags", f"""
    WITH k AS (SELECT v.urn, {PII_SQL} AS pii_type, v.variant, c.kind FROM v_columns v LEFT JOIN (SELECT column_urn, max(constraint_type) AS kind FROM v_constraints GROUP BY 1) c ON c.column_urn = v.urn)
    """ + _flag_sql("k", "urn", {"is_pii": "pii_type IS NOT NULL OR variant = 6", "has_constraints": "kind IS NOT NULL", "is_primary_key": "kind = 'primary_key'", "is_foreign_key": "kind = 'foreign_key'"}))
def flt26_column_flags(c: Catalog):
    kinds = c.view("v_constraints").groupBy(F.col("column_urn").alias("urn")).agg(F.collect_set("constraint_type").alias("constraint_types"))
    rows = pii.tag_columns(c.view("v_columns")).withColumn("semantic_type", F.when(F.col("variant") == 6, "pii")).join(kinds, "urn", "left")
    return _met(rows, "urn", flags.columns())


@query("flt26_capsule_flags", f"""
    WITH k AS (SELECT c.urn, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(i, 0) AS i FROM v_capsules c LEFT JOIN (SELECT capsule_urn AS u, count(*) AS n, count(*) FILTER ({PII_SQL} IS NOT NULL) AS p FROM v_columns GROUP BY 1) ON u = c.urn
      LEFT JOIN (SELECT capsule_urn AS w, count(*) FILTER (is_unique) AS i FROM v_indexes GROUP BY 1) ON w = c.urn)
    """ + _flag_sql("k", "urn", {"has_pii": "p > 0", "has_columns": "n > 0", "is_indexed": "i > 0"}))
def flt26_capsule_flags(c: Catalog):
    of = pii.tag_columns(c.view("v_columns")).groupBy(F.col("capsule_urn").alias("urn")).agg(F.count("*").alias("n_columns"), F.count("pii_type").alias("n_pii"))
    indexed = c.view("v_indexes").groupBy(F.col("capsule_urn").alias("urn")).agg(F.count_if("is_unique").alias("n_indexes"))
    rows = c.view("v_capsules").select("urn").join(of, "urn", "left").join(indexed, "urn", "left").na.fill(0)
    return _met(rows, "urn", flags.capsules())


@query("flt26_contract_flags", _flag_sql("v_contracts", "id", {
    "is_active": "contract_status = 'active'", "is_deprecated": f"contract_status = 'deprecated' OR deprecation_date <= DATE '{TODAY}'", "has_freshness_sla": "freshness_hours IS NOT NULL",
    "has_completeness_sla": "completeness_sla IS NOT NULL OR row_count_min IS NOT NULL OR freshness_hours > 1000", "has_quality_sla": "quality_score_sla IS NOT NULL OR contract_owner = 'owner_3'"}))
def flt26_contract_flags(c: Catalog):
    rows = c.view("v_contracts").withColumns({"row_count_max": F.when(F.col("freshness_hours") > 1000, 9), "critical_rules": F.when(F.col("contract_owner") == "owner_3", F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))})
    return _met(rows, "id", flags.contracts(TODAY))


_INCIDENTS = """i AS (SELECT *, value_of, detected_at - INTERVAL 2 HOUR AS started, CASE WHEN incident_status = 'resolved' THEN detected_at + INTERVAL 90 MINUTE END AS resolved FROM (SELECT v_incidents.*, e.value AS value_of FROM v_incidents JOIN events e ON concat('incident:', CAST(e.event_id AS STRING)) = id))"""


def _incidents(c: Catalog):
    value = c.table("events").select(F.concat(F.lit("incident:"), F.col("event_id").cast("string")).alias("id"), "value")
    hours = lambda n: F.make_dt_interval(mins=F.lit(n))
    return c.view("v_incidents").join(value, "id").withColumns({
        "affected_consumers": F.when(F.col("value") > 100, F.array(F.lit("team"))), "downstream_impact": F.when(F.col("value") < 5, "reports").when(F.col("value") < 10, ""),
        "breach_started_at": F.col("detected_at") - hours(120), "resolved_at": F.when(F.col("incident_status") == "resolved", F.col("detected_at") + hours(90)),
    })


@query("flt26_incident_flags", f"WITH {_INCIDENTS} " + _flag_sql("i", "id", {"is_open": "incident_status IN ('open', 'investigating')", "is_resolved": "incident_status IN ('resolved', 'closed', 'false_positive')", "has_impact_assessment": "value_of > 100 OR value_of < 5"}))
def flt26_incident_flags(c: Catalog):
    return _met(_incidents(c), "id", flags.incidents())


@query("flt26_incident_times", f"WITH {_INCIDENTS} SELECT id, 7200 AS time_to_detect, CASE WHEN incident_status = 'resolved' THEN 5400 END AS time_to_resolve FROM i")
def flt26_incident_times(c: Catalog):
    return _incidents(c).select("id", *[v.alias(k) for k, v in flags.incident_times().items()])


@query("flt26_rule_flags", _flag_sql("v_quality_rules", "id", {"is_capsule_rule": "is_enabled", "is_column_rule": "NOT blocking"}))
def flt26_rule_flags(c: Catalog):
    rows = c.view("v_quality_rules").withColumns({"capsule_urn": F.when(F.col("is_enabled"), F.col("capsule_urn")), "column_urn": F.when(~F.col("blocking"), F.col("column_urn"))})
    return _met(rows, "id", flags.quality_rules())


@query("flt26_version_flags", "WITH k AS (SELECT *, concat(capsule_urn, '#', CAST(version_number AS STRING)) AS id FROM v_versions) " + _flag_sql("k", "id", {
    "has_git_context": "git_commit_sha IS NOT NULL OR version_number = 5", "is_breaking_change": "breaking_change", "has_deployment_info": "change_type = 'created' OR version_number = 7"}))
def flt26_version_flags(c: Catalog):
    n = F.col("version_number")
    rows = c.view("v_versions").withColumns({
        "id": F.concat("capsule_urn", F.lit("#"), n.cast("string")), "git_branch": F.when(n == 5, "main").when(n == 6, ""), "git_tag": F.lit(None).cast("string"),
        "deployed_at": F.when(F.col("change_type") == "created", F.col("created_at")), "deployed_by": F.when(n == 7, "team"), "deployment_context": F.lit(""),
    })
    return _met(rows, "id", flags.versions())


@query("flt26_profile_flags", _flag_sql("v_profiles", "column_urn", {"is_numeric_profile": "column_urn LIKE '%.amount%'", "is_string_profile": "unique_percentage > 50", "has_temporal_data": "column_urn LIKE '%.created%'"}))
def flt26_profile_flags(c: Catalog):
    named = lambda part: F.col("column_urn").contains(part)
    rows = c.view("v_profiles").withColumns({
        "mean_value": F.lit(None).cast("double"), "median_value": F.when(named(".amount"), 1.0), "min_length": F.when(F.col("unique_percentage") > 50, 1), "max_length": F.lit(None).cast("int"),
        "earliest_timestamp": F.when(named(".created"), F.lit(TODAY).cast("timestamp")), "latest_timestamp": F.lit(None).cast("timestamp"),
    })
    return _met(rows, "column_urn", flags.profiles())


@query("flt26_term_flags", _flag_sql("v_terms", "term", {"is_approved": "approval_status = 'approved'"}))
def flt26_term_flags(c: Catalog):
    return _met(c.view("v_terms"), "term", flags.terms())


# ------------------------------------------------------- policies, code, terms


@query("flt6_policies_of", """
    SELECT id, 'column' AS filter FROM v_policies WHERE cross_border_transfer AND capsule_urn IN (SELECT capsule_urn FROM v_columns WHERE name = 'ssn_1')
    UNION ALL SELECT id, 'capsule' FROM v_policies WHERE capsule_urn IN (SELECT urn FROM v_capsules WHERE layer = 'gold') UNION ALL SELECT id, 'one_capsule' FROM v_policies WHERE capsule_urn = 'urn:cat:part:3'
    UNION ALL SELECT id, 'one_column' FROM v_policies WHERE cross_border_transfer AND capsule_urn = 'urn:cat:part:4'""")
def flt6_policies_of(c: Catalog):
    """Policies of columns and tables, by a table of keys and by one key."""
    rows = c.view("v_policies").withColumn("column_urn", F.when(F.col("cross_border_transfer"), F.concat("capsule_urn", F.lit(".ssn_1"))))
    named = lambda df, name: df.select("id", F.lit(name).alias("filter"))
    return (
        named(filters.linked(rows, "column_urn", c.view("v_columns"), "urn"), "column").unionByName(named(filters.linked(rows, "capsule_urn", c.view("v_capsules"), "urn", F.col("layer") == "gold"), "capsule"))
        .unionByName(named(rows.where(filters.policies(capsule_urn="urn:cat:part:3")), "one_capsule")).unionByName(named(rows.where(filters.policies(column_urn="urn:cat:part:4.ssn_1")), "one_column"))
    )


@query("flt13_code_of_edges", """
    SELECT file_path, concat(e.source_urn, '>', e.target_urn) AS edge_id FROM v_code k JOIN v_capsule_edges e ON e.target_urn = k.capsule_urn WHERE edge_type = 'references'""")
def flt13_code_of_edges(c: Catalog):
    """Code that belongs to an edge: the files behind all references, by the edges' ids."""
    edges = c.view("v_capsule_edges").select(F.concat_ws(">", "source_urn", "target_urn").alias("edge_id"), F.col("target_urn").alias("capsule_urn"), "edge_type")
    code = c.view("v_code").join(edges.drop("edge_type"), "capsule_urn")
    return filters.linked(code, "edge_id", edges, "edge_id", F.col("edge_type") == "references").select("file_path", "edge_id")


@query("flt14_columns_of_approved_terms", """
    SELECT column_urn, term FROM v_column_terms WHERE replace(term, 'NATION_', '') IN (SELECT concat('term:', CAST(n_nationkey AS STRING)) FROM nation WHERE n_regionkey > 1)""")
def flt14_columns_of_approved_terms(c: Catalog):
    approved = c.table("nation").where("n_regionkey > 1").select(F.concat(F.lit("term:NATION_"), F.col("n_nationkey").cast("string")).alias("term"))
    return filters.linked(c.view("v_column_terms"), "term", approved, "term").select("column_urn", "term")


@query("flt14_term_exists", """
    WITH asked AS (SELECT urn AS column_urn, concat('term:NATION_', CAST(variant % 3 AS STRING)) AS term FROM v_columns)
    SELECT a.column_urn, a.term, t.term IS NOT NULL AS linked FROM asked a LEFT JOIN v_column_terms t ON t.column_urn = a.column_urn AND t.term = a.term""")
def flt14_term_exists(c: Catalog):
    asked = c.view("v_columns").select(F.col("urn").alias("column_urn"), F.concat(F.lit("term:NATION_"), (F.col("variant") % 3).cast("string")).alias("term"))
    return filters.exists_link(asked, c.view("v_column_terms"))


# ------------------------------------------------------------ versions in time

_SPANS = """spans AS (SELECT concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS column_urn, concat('v', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS version, l_quantity AS size, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS valid_from,
      CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) ELSE l_shipdate + to_days(CAST(l_quantity * 20 AS INTEGER)) END AS valid_to FROM lineitem),
    asked AS (SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS column_urn, x.at FROM part, (SELECT CAST('1997-06-01' AS TIMESTAMP) AS at UNION ALL SELECT CAST('2000-01-15 05:00:00' AS TIMESTAMP) UNION ALL SELECT CAST('2003-01-01' AS TIMESTAMP)) x)"""


def spans(c: Catalog):
    """Versions of columns with a time of validity: hours, months, or without an end."""
    line, size = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    start = F.col("l_shipdate")
    hours, days = F.make_dt_interval(hours=size), F.make_dt_interval(days=(F.col("l_quantity") * 20).cast("int"))
    return c.table("lineitem").select(
        F.concat(F.lit("urn:cat:part:"), F.col("l_partkey").cast("string")).alias("column_urn"), F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit("."), line.cast("string")).alias("version"),
        F.when(line != 7, start).alias("valid_from"), F.when(line % 4 == 0, F.lit(None)).when(line % 4 == 1, start + hours).otherwise(start + days).alias("valid_to"),
    )


@query("flt12_versions_as_of", f"""
    WITH {_SPANS} SELECT a.column_urn, strftime(a.at, '%Y-%m-%d %H') AS at_hour, version FROM asked a JOIN spans s ON s.column_urn = a.column_urn AND (s.valid_from IS NULL OR s.valid_from <= a.at) AND (s.valid_to IS NULL OR a.at < s.valid_to)""")
def flt12_versions_as_of(c: Catalog):
    times = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in ("1997-06-01 00:00:00", "2000-01-15 05:00:00", "2003-01-01 00:00:00")]))
    asked = c.table("part").select(F.concat(F.lit("urn:cat:part:"), F.col("p_partkey").cast("string")).alias("column_urn"), times.alias("at"))
    found = intervals.as_of(asked, spans(c), ["column_urn"], "at")
    return found.select("column_urn", F.date_format("at", "yyyy-MM-dd HH").alias("at_hour"), "version")


# -------------------------------------------------------- selectors and search


@query("j9_path_selectors", f"""
    WITH {_NODE_SQL}, s AS (SELECT DISTINCT concat('shop.P', p_size, '*') AS selector, concat('shop.p', p_size) AS p FROM c UNION SELECT DISTINCT concat('7', p_size, '/*'), concat('7', p_size) FROM c UNION SELECT '*', '' FROM c UNION SELECT 'nothing/like/it*', 'nothing/like/it' FROM c)
    SELECT DISTINCT selector, unique_id FROM s JOIN c ON kind = 'model' AND contains(unique_id, p)""")
def j9_path_selectors(c: Catalog):
    rows = nodes(c)
    size = F.regexp_extract(F.col("depends_on")[0], "([0-9]+)$", 1)
    wanted = rows.select(F.explode(F.array(F.concat(F.lit("shop.P"), size, F.lit("*")), F.concat(F.lit("7"), size, F.lit("/*")), F.lit("*"), F.lit("nothing/like/it*"))).alias("selector")).distinct()
    return manifest.select_models(wanted, rows)


@query("flt4_many_searches", """
    WITH s AS (SELECT DISTINCT lower(substr(p_name, 1 + p_size % 4, 1 + p_size % 6)) AS pattern FROM part)
    SELECT pattern, urn AS id FROM s JOIN v_capsules ON contains(lower(concat_ws(' ', name, description)), pattern)""")
def flt4_many_searches(c: Catalog):
    """Every search that was asked, over names and descriptions of all tables at once."""
    texts = c.view("v_capsules").select(F.col("urn").alias("id"), F.lower(F.concat_ws(" ", "name", "description")).alias("text"))
    size = F.col("p_size")
    return substring_index.containing(texts, c.table("part").select(F.lower(F.substring(F.col("p_name"), 1 + size % 4, 1 + size % 6)).alias("pattern")))


# ------------------------------------------------- footprints and reports


@query("j11_footprint_rows", """
    SELECT pipeline_urn, edge_type, e.capsule_urn, count(DISTINCT task_urn) AS tasks, name, layer FROM v_task_edges e LEFT JOIN v_capsules c ON c.urn = e.capsule_urn GROUP BY 1, 2, 3, 5, 6""")
def j11_footprint_rows(c: Catalog):
    return rollups.footprint_rows(c.view("v_task_edges"), c.view("v_capsules"))


_LINKED = "linked AS (SELECT a.urn AS source_column_urn, b.urn AS target_column_urn FROM v_columns a JOIN v_columns b ON b.capsule_urn = a.capsule_urn AND b.variant = a.variant AND a.data_type = 'DECIMAL' AND b.data_type = 'TIMESTAMP')"
_KEYED = "regexp_matches(name, '_id$|^id$|name|amount|date|_date$')"


@query("cf4_column_lineage", f"""
    WITH {cq._FRAMES}, {_LINKED}, ends AS (SELECT source_column_urn AS u FROM linked UNION SELECT target_column_urn FROM linked), f AS (SELECT urn, key_column AND urn NOT IN (SELECT u FROM ends) AS bad FROM col)
    SELECT 'DIM6_008' AS rule_id, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, 0 AS not_applicable FROM f""")
def cf4_column_lineage(c: Catalog):
    """Key columns must have lineage: amounts and timestamps of one variant are linked."""
    cols = c.view("v_columns")
    times = cols.where("data_type = 'TIMESTAMP'").select("capsule_urn", "variant", F.col("urn").alias("target_column_urn"))
    linked = cols.where("data_type = 'DECIMAL'").select("capsule_urn", "variant", F.col("urn").alias("source_column_urn")).join(times, ["capsule_urn", "variant"]).select("source_column_urn", "target_column_urn")
    t = cq.tables(c) | {"column_edges": linked}
    capsules, columns = cf.capsule_frame(t), cf.column_frame(t)
    rule = [r for r in cf.builtin_rules(capsules, columns, cq.NOW) if r.rule_id == "DIM6_008"]
    return cf.rule_counts(capsules, columns, rule).select("rule_id", "passed", "failed", "not_applicable")


def _message_sql() -> str:
    named = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in (r[0], r[1], r[2], r[3])) + ")" for listed in cf.RULES.values() for r in listed)
    parts = []
    for rules, frame, owner, word in ((cq._CAP_RULES, "cap", "urn", "Table"), (cq._COL_RULES, "col", "capsule_urn", "Column")):
        parts += [f"SELECT '{r}' AS rule_id, urn AS subject_urn, name AS subject_name, {owner} AS capsule_urn, '{word}' AS word FROM {frame} WHERE ({applies}) AND ({fails})" for r, (applies, fails) in rules.items()]
    return f"""WITH {cq._FRAMES}, named(rule_id, rule_name, severity, category) AS (VALUES {named}), failed AS ({' UNION ALL '.join(parts)})
      SELECT rule_id, rule_name, category, severity, subject_urn AS capsule_urn, subject_name AS capsule_name, concat(word, ' ''', subject_name, ''' violates ', rule_id, ': ', rule_name) AS message FROM failed JOIN named USING (rule_id)"""


@query("snk14_whole_report", _message_sql())
def snk14_whole_report(c: Catalog):
    """Violations of all rules with their messages."""
    rows, rules = cq.evaluated(c, messages=True)
    return export.conformance_report(cf.violations(rows, rules))


@query("snk14_report_scores", f"""
    WITH {cq._RESULTS}, s AS (SELECT 'total' AS part, 'all' AS name, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed FROM results UNION ALL SELECT 'category', category, CAST(sum(passed) AS BIGINT), CAST(sum(failed) AS BIGINT) FROM results GROUP BY 2)
    SELECT part, name, passed, failed, round(CASE WHEN passed + failed > 0 THEN passed / (passed + failed) * 100 ELSE 100 END, 4) AS score FROM s""")
def snk14_report_scores(c: Catalog):
    return export.conformance_scores(cq.counted(c))
