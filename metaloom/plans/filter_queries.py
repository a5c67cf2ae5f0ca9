"""Catalog filter queries: many named predicates per table, one scan each."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.operators import filters as f
from metaloom.operators import pii, rollups
from metaloom.plans.pii_queries import PII_SQL, SEMANTIC_SQL
from metaloom.plans.registry import Catalog, query

TODAY = "2001-09-01"


def register(name: str, view: str, key: str, cases: Mapping[str, tuple[Callable[[], Column], str]]) -> None:
    """Predicates are made lazily: a Column needs a running session."""
    oracle = " UNION ALL ".join(f"SELECT {key}, '{label}' AS filter FROM {view} WHERE {sql}" for label, (_, sql) in cases.items())

    def run(c: Catalog):
        return f.matches(c.view(view), key, {label: make() for label, (make, _) in cases.items()})

    query(name, oracle)(run)


register("flt2_capsules", "v_capsules", "urn", {
    "layer": (lambda: f.capsules(layer="gold"), "layer = 'gold'"), "domain": (lambda: f.capsules(domain="Brand#7"), "domain = 'Brand#7'"),
    "type": (lambda: f.capsules(capsule_type="model"), "capsule_type = 'model'"), "system": (lambda: f.capsules(source_system="system_1"), "source_system = 'system_1'"),
    "layer_before_type": (lambda: f.capsules(layer="silver", capsule_type="model"), "layer = 'silver'"),
})


@query("flt3_columns", f"""
    WITH t AS (SELECT *, {SEMANTIC_SQL} AS semantic_type FROM (SELECT *, {PII_SQL} AS pii_type FROM v_columns))
    SELECT urn, 'pii' AS filter FROM t WHERE pii_type IS NOT NULL UNION ALL SELECT urn, 'email' FROM t WHERE pii_type = 'email'
    UNION ALL SELECT urn, 'metric' FROM t WHERE semantic_type = 'metric' UNION ALL SELECT urn, 'capsule' FROM t WHERE capsule_urn = 'urn:cat:part:3'""")
def flt3_columns(c: Catalog):
    from metaloom.functions.classify import semantic_type

    rows = pii.tag_columns(c.view("v_columns")).withColumn("semantic_type", semantic_type(F.col("name"), F.col("pii_type")))
    return f.matches(rows, "urn", {"pii": f.columns(pii=True), "email": f.columns(pii_type="email"), "metric": f.columns(semantic_type="metric"), "capsule": f.columns(capsule_urn="urn:cat:part:3")})


register("flt4_search", "v_capsules", "urn", {
    "text": (lambda: f.capsules(search="RING"), "contains(lower(name), 'ring') OR contains(lower(coalesce(description, '')), 'ring')"),
    "literal": (lambda: f.contains_text("m_", "name"), "contains(lower(name), 'm_')"),
    "percent": (lambda: f.contains_text("%", "name", "description"), "contains(name, '%')"),
})
register("flt5_array_contains", "v_policies", "id", {
    "framework": (lambda: f.policies(framework="CCPA"), "list_contains(string_split(frameworks_csv, ','), 'CCPA')"),
})
register("flt6_policies", "v_policies", "id", {
    "active": (lambda: f.policies(active=True), "policy_status = 'active'"), "sensitivity": (lambda: f.policies(sensitivity_level="restricted"), "sensitivity_level = 'restricted'"),
    "review_due": (lambda: f.policies(today=TODAY, review_due=True), f"next_review_date <= DATE '{TODAY}'"),
})
register("flt7_contracts", "v_contracts", "id", {
    "active": (lambda: f.contracts(contract_status="active"), "contract_status = 'active'"), "owner": (lambda: f.contracts(contract_owner="owner_3"), "contract_owner = 'owner_3'"),
    "support": (lambda: f.contracts(support_level="24x7"), "support_level = '24x7'"),
    "deprecated": (lambda: f.contracts(deprecated_on=TODAY), f"contract_status = 'deprecated' OR deprecation_date <= DATE '{TODAY}'"),
    "freshness": (lambda: f.contracts(has_freshness=True), "freshness_hours IS NOT NULL"), "quality": (lambda: f.contracts(has_quality=True), "quality_score_sla IS NOT NULL"),
    "completeness": (lambda: f.contracts(has_completeness=True), "completeness_sla IS NOT NULL OR row_count_min IS NOT NULL"),
})
register("flt8_incidents", "v_incidents", "id", {
    "contract": (lambda: f.incidents(contract_id="contract:5"), "contract_id = 'contract:5'"), "capsule": (lambda: f.incidents(capsule_urn="urn:cat:part:7"), "capsule_urn = 'urn:cat:part:7'"),
    "type": (lambda: f.incidents(incident_type="freshness"), "incident_type = 'freshness'"), "critical": (lambda: f.incidents(incident_severity="critical"), "incident_severity = 'critical'"),
    "open": (lambda: f.incidents(is_open=True), "incident_status IN ('open', 'investigating')"), "resolved": (lambda: f.incidents(is_resolved=True), "incident_status IN ('resolved', 'closed', 'false_positive')"),
    "root_cause": (lambda: f.incidents(root_cause_category="upstream"), "root_cause_category = 'upstream'"),
})
register("flt9_quality_rules", "v_quality_rules", "id", {
    "type": (lambda: f.quality_rules(rule_type="unique"), "rule_type = 'unique'"), "category": (lambda: f.quality_rules(rule_category="validity"), "rule_category = 'validity'"),
    "enabled": (lambda: f.quality_rules(enabled=True), "is_enabled"), "blocking": (lambda: f.quality_rules(blocking=True), "blocking"),
    "capsule": (lambda: f.quality_rules(capsule_urn="urn:cat:part:9"), "capsule_urn = 'urn:cat:part:9'"),
})
register("flt10_masking_rules", "v_masking_rules", "id", {
    "enabled": (lambda: f.masking_rules(enabled=True), "is_enabled"), "method": (lambda: f.masking_rules(masking_method="hashing"), "masking_method = 'hashing'"),
    "reversible": (lambda: f.masking_rules(reversible=True), "is_reversible"),
    "role": (lambda: f.masking_rules(role="analyst"), "roles_csv = '' OR (NOT list_contains(string_split(exempt_csv, ','), 'analyst') AND list_contains(string_split(roles_csv, ','), 'analyst'))"),
})
register("flt11_constraints", "v_constraints", "column_urn", {
    "pk": (lambda: f.constraints(constraint_type="primary_key"), "constraint_type = 'primary_key'"), "fk": (lambda: f.constraints(constraint_type="foreign_key"), "constraint_type = 'foreign_key'"),
    "referenced": (lambda: f.constraints(referenced_table_urn="urn:cat:part:0"), "referenced_table_urn = 'urn:cat:part:0'"),
})
register("flt11_indexes", "v_indexes", "index_name", {
    "type": (lambda: f.indexes(index_type="hash"), "index_type = 'hash'"), "unique": (lambda: f.indexes(unique=True), "is_unique"), "primary": (lambda: f.indexes(primary=True), "is_primary"),
    "column": (lambda: f.indexes(column="ssn_1"), "list_contains(string_split(column_csv, ','), 'ssn_1')"),
})
register("flt12_versions", "v_versions", "capsule_urn", {
    "number": (lambda: f.versions(version_number=3), "version_number = 3"), "change": (lambda: f.versions(change_type="schema_change"), "change_type = 'schema_change'"),
    "commit": (lambda: f.versions(git_commit_sha="sha2"), "git_commit_sha = 'sha2'"), "breaking": (lambda: f.versions(breaking=True), "breaking_change"),
})
register("flt13_code", "v_code", "file_path", {
    "language": (lambda: f.code(language="sql"), "language = 'sql'"), "commit": (lambda: f.code(git_commit_sha="sha20"), "git_commit_sha = 'sha20'"),
    "file": (lambda: f.code(file_path="models/small/2.sql"), "file_path = 'models/small/2.sql'"),
})
register("flt14_terms", "v_terms", "term", {
    "domain": (lambda: f.terms(domain="domain:ASIA"), "domain = 'domain:ASIA'"), "category": (lambda: f.terms(category="trade"), "category = 'trade'"),
    "approved": (lambda: f.terms(approval_status="approved"), "approval_status = 'approved'"),
})


@query("flt14_capsules_of_approved_terms", "SELECT urn, name FROM v_capsules WHERE urn IN (SELECT capsule_urn FROM v_capsule_terms JOIN v_terms USING (term) WHERE approval_status = 'approved')")
def flt14_capsules_of_approved_terms(c: Catalog):
    approved = f.linked(c.view("v_capsule_terms"), "term", c.view("v_terms"), "term", f.terms(approval_status="approved"))
    return f.linked(c.view("v_capsules"), "urn", approved, "capsule_urn").select("urn", "name")


register("flt15_tags", "v_tags", "tag", {
    "category": (lambda: f.tags(category="kind"), "category = 'kind'"), "sensitivity": (lambda: f.tags(sensitivity_level="internal"), "sensitivity_level = 'internal'"),
})


@query("flt15_tags_of_columns", "SELECT column_urn, tag, category FROM v_column_tags JOIN v_tags USING (tag)")
def flt15_tags_of_columns(c: Catalog):
    return c.view("v_column_tags").join(c.view("v_tags"), "tag").select("column_urn", "tag", "category")


register("flt16_products", "v_data_products", "product", {
    "domain": (lambda: f.data_products(domain="economy"), "domain = 'economy'"), "owner": (lambda: f.data_products(owner="owner_Brand#3"), "owner = 'owner_Brand#3'"),
    "status": (lambda: f.data_products(status="draft"), "status = 'draft'"),
})


@query("flt16_output_members", "SELECT product, capsule_urn FROM v_product_members WHERE role = 'output' AND product IN (SELECT product FROM v_data_products WHERE status = 'active')")
def flt16_output_members(c: Catalog):
    outputs = c.view("v_product_members").filter("role = 'output'").select("product", "capsule_urn")
    return f.linked(outputs, "product", c.view("v_data_products"), "product", f.data_products(status="active"))


register("flt17_value_domains", "v_value_domains", "domain_name", {
    "enum": (lambda: f.value_domains(domain_type="enum"), "domain_type = 'enum'"), "pattern": (lambda: f.value_domains(domain_type="pattern"), "domain_type = 'pattern'"),
    "owner": (lambda: f.value_domains(owner="owner_1"), "owner = 'owner_1'"), "extensible": (lambda: f.value_domains(extensible=True), "is_extensible"),
})
register("flt18_workflows", "v_workflows", "urn", {
    "type": (lambda: f.workflows(pipeline_type="airflow_dag"), "pipeline_type = 'airflow_dag'"), "source": (lambda: f.workflows(source_system="system_2"), "source_system = 'system_2'"),
    "active": (lambda: f.workflows(active=True), "is_active"), "paused": (lambda: f.workflows(paused=True), "is_paused"), "search": (lambda: f.workflows(search="0007"), "contains(name, '0007')"),
})
register("flt19_task_dependencies", "v_task_dependencies", "capsule_urn", {
    "task": (lambda: f.task_dependencies(dag_id="dag_3", task_id="task_2"), "dag_id = 'dag_3' AND task_id = 'task_2'"), "readers": (lambda: f.task_dependencies(dependency_type="read"), "dependency_type = 'read'"),
    "writers": (lambda: f.task_dependencies(dependency_type="write"), "dependency_type = 'write'"), "transformers": (lambda: f.task_dependencies(dependency_type="transform"), "dependency_type = 'transform'"),
    "critical": (lambda: f.task_dependencies(critical=True, active=True), "criticality_score >= 0.7 AND is_active"),
})
register("flt20_changes", "v_changes", "change_id", {
    "type": (lambda: f.changes(change_type="delete"), "change_type = 'delete'"), "failed": (lambda: f.changes(success=False), "success = false"),
    "range": (lambda: f.changes(since="2024-01-05 00:00:00", until="2024-01-09 00:00:00"), "change_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'"),
})


@query("flt20_recent_similar", """
    SELECT change_type, change_id, rank FROM (SELECT change_type, change_id, row_number() OVER (PARTITION BY change_type ORDER BY change_timestamp DESC, change_id DESC) AS rank
      FROM v_changes WHERE success) WHERE rank <= 10""")
def flt20_recent_similar(c: Catalog):
    done = c.view("v_changes").filter("success").select("change_type", "change_id", "change_timestamp")
    return rollups.top_k_per_key(done, ["change_type"], [F.desc("change_timestamp"), F.desc("change_id")], 10).drop("change_timestamp")


register("flt21_alerts", "v_alerts", "id", {
    "type": (lambda: f.alerts(alert_type="pii_change"), "alert_type = 'pii_change'"), "unresolved": (lambda: f.alerts(resolved=False), "NOT resolved"),
    "critical": (lambda: f.alerts(severity="critical", resolved=False), "severity = 'critical' AND NOT resolved"), "acknowledged": (lambda: f.alerts(acknowledged=True), "acknowledged"),
    "column": (lambda: f.alerts(column_urn="urn:cat:part:4.email_0"), "column_urn = 'urn:cat:part:4.email_0'"),
})


@query("flt22_violations", """
    SELECT id, 'open_error' AS filter FROM v_violations WHERE status = 'open' AND severity = 'error' UNION ALL SELECT id, 'ingestion' FROM v_violations WHERE ingestion_id = 'ingest_2'
    UNION ALL SELECT id, 'category' FROM v_violations JOIN v_rules USING (rule_id) WHERE category = 'policy' UNION ALL SELECT id, 'rule_set' FROM v_violations JOIN v_rules USING (rule_id) WHERE rule_set = 'set_a'
    UNION ALL SELECT id, 'subject' FROM v_violations WHERE subject = 11""")
def flt22_violations(c: Catalog):
    rows = rollups.with_rules(c.view("v_violations"), c.view("v_rules"))
    return f.matches(rows, "id", {"open_error": f.violations(status="open", severity="error"), "ingestion": f.violations(ingestion_id="ingest_2"),
                                  "category": f.violations(category="policy"), "rule_set": f.violations(rule_set="set_a"), "subject": f.violations(subject=11)})


register("flt23_rules", "v_rules", "rule_id", {
    "set": (lambda: f.rules(rule_set="set_a"), "rule_set = 'set_a'"), "category": (lambda: f.rules(category="policy"), "category = 'policy'"),
    "scope": (lambda: f.rules(scope="column"), "scope = 'column'"), "enabled": (lambda: f.rules(enabled=True), "enabled"),
})
register("flt26_policy_flags", "v_policies", "id", {
    "in_force": (lambda: f.policy_in_force(TODAY), f"policy_status = 'active' AND DATE '{TODAY}' BETWEEN effective_from AND effective_to"),
    "requires_review": (lambda: f.policies(today=TODAY, review_due=True), f"next_review_date <= DATE '{TODAY}'"), "pii_policy": (lambda: f.pii_policy(), "classification_csv IN ('gdpr', 'ccpa', 'pii', 'personal_data')"),
    "regulated": (lambda: F.size(f.csv_list("frameworks_csv")) > 0, "frameworks_csv <> ''"),
})
register("flt26_masking_flags", "v_masking_rules", "id", {
    "role_based": (lambda: (F.size(f.csv_list("roles_csv")) > 0) | (F.size(f.csv_list("exempt_csv")) > 0), "roles_csv <> '' OR exempt_csv <> ''"),
    "conditional": (lambda: F.col("apply_condition").isNotNull(), "apply_condition IS NOT NULL"), "preserving": (lambda: F.col("preserve_length"), "preserve_length"),
})
register("flt26_code_flags", "v_code", "file_path", {
    "located": (lambda: F.col("file_path").isNotNull() & F.col("line_start").isNotNull(), "line_start IS NOT NULL"), "git": (lambda: F.col("git_commit_sha").isNotNull(), "git_commit_sha IS NOT NULL"),
})
register("flt26_index_flags", "v_indexes", "index_name", {"composite": (lambda: F.size(f.csv_list("column_csv")) > 1, "contains(column_csv, ',')")})
register("flt27_domains", "v_domain_tree", "domain", {"roots": (lambda: f.domain_roots(), "parent IS NULL"), "children": (lambda: f.domain_children("ASIA"), "parent = 'ASIA'")})
register("flt28_owners", "v_owners", "owner", {"team": (lambda: f.owners(owner_type="team"), "owner_type = 'team'"), "user": (lambda: f.owners(owner_type="user"), "owner_type = 'user'")})


@query("flt29_nested_lists", """
    SELECT 'domain' AS parent_kind, domain AS parent, urn AS child FROM v_capsules UNION ALL SELECT 'product', product, capsule_urn FROM v_product_members
    UNION ALL SELECT 'capsule', capsule_urn, concat(dag_id, '.', task_id) FROM v_task_dependencies""")
def flt29_nested_lists(c: Catalog):
    rows = [
        c.view("v_capsules").select(F.lit("domain").alias("parent_kind"), F.col("domain").alias("parent"), F.col("urn").alias("child")),
        c.view("v_product_members").select(F.lit("product").alias("parent_kind"), F.col("product").alias("parent"), F.col("capsule_urn").alias("child")),
        c.view("v_task_dependencies").select(F.lit("capsule").alias("parent_kind"), F.col("capsule_urn").alias("parent"), F.concat_ws(".", "dag_id", "task_id").alias("child")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
