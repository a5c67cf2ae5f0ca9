"""Catalog metadata views over the given tables.

Each view is plain SQL that runs unchanged in Spark and DuckDB, reads whole
tables and grows with them.  They stand for the metadata tables a catalog
export would deliver (``metaloom.sources`` reads real exports).  Views may
refer to one another; ``with_clause`` resolves the order.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: the fixed "now" of every registered query; operators take it as a parameter
NOW = "2001-09-01 00:00:00"

VIEWS: dict[str, str] = {
    # ------------------------------------------------------------- tables
    "v_capsules": """
        SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS urn,
          concat(CASE p_size % 3 WHEN 0 THEN 'dim_' WHEN 1 THEN 'stg_' ELSE 'x' END, replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name,
          CASE p_type WHEN 'ECONOMY' THEN 'model' ELSE lower(p_type) END AS capsule_type,
          CASE p_size % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS layer,
          p_brand AS domain,
          CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS description,
          p_size % 4 > 0 AS has_tests,
          CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat('owner_', CAST(p_size % 11 AS STRING)) END AS owner,
          CASE WHEN p_size % 6 = 0 THEN '' ELSE concat(lower(p_type), ',', p_brand) END AS tags_csv,
          concat('system_', CAST(p_size % 2 AS STRING)) AS source_system,
          concat('db', CAST(p_size % 2 AS STRING)) AS database_name,
          concat('schema_', CAST(p_size % 3 AS STRING)) AS schema_name,
          p_size AS days_since_analysis
        FROM part""",
    "v_columns": """
        SELECT DISTINCT concat('urn:cat:part:', CAST(l_partkey AS STRING), '.', c.name, CAST(l_suppkey % 7 AS STRING)) AS urn,
          concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS capsule_urn,
          concat(c.name, CAST(l_suppkey % 7 AS STRING)) AS name, c.data_type AS data_type,
          CASE WHEN l_suppkey % 7 < 3 THEN NULL ELSE concat('holds ', c.name) END AS description,
          CAST(l_suppkey % 7 AS INTEGER) AS variant
        FROM lineitem JOIN (
          SELECT 0 AS k, 'email_' AS name, 'VARCHAR' AS data_type UNION ALL SELECT 1, 'phone_hash_', 'VARCHAR'
          UNION ALL SELECT 2, 'amount_', 'DECIMAL' UNION ALL SELECT 3, 'order_status_', 'VARCHAR'
          UNION ALL SELECT 4, 'created_at_', 'TIMESTAMP' UNION ALL SELECT 5, 'ssn_', 'VARCHAR') c
          ON c.k = l_linenumber % 6""",
    "v_constraints": """
        SELECT urn AS column_urn, capsule_urn,
          CASE variant WHEN 0 THEN 'primary_key' WHEN 1 THEN 'foreign_key' WHEN 2 THEN 'unique' WHEN 3 THEN 'check' WHEN 4 THEN 'not_null' ELSE 'default' END AS constraint_type,
          concat(CASE variant WHEN 0 THEN 'pk_' WHEN 1 THEN CASE data_type WHEN 'VARCHAR' THEN 'fk_' ELSE 'FOREIGN' END WHEN 2 THEN 'uq_' WHEN 3 THEN 'ck' ELSE 'c_' END, name) AS constraint_name,
          CASE variant WHEN 1 THEN 'urn:cat:part:0' ELSE NULL END AS referenced_table_urn
        FROM v_columns WHERE data_type <> 'DECIMAL'""",
    "v_indexes": """
        SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          concat(CASE WHEN p_size % 4 = 0 THEN 'ix_' ELSE 'idx_' END, CAST(p_partkey AS STRING)) AS index_name,
          CASE WHEN p_size % 5 = 0 THEN 'hash' ELSE 'btree' END AS index_type,
          p_size % 3 = 0 AS is_unique, p_size % 9 = 0 AS is_primary,
          CASE WHEN p_size % 2 = 0 THEN 'email_1,order_status_1,ssn_1' ELSE 'created_at_1' END AS column_csv
        FROM part""",
    "v_quality_rules": """
        SELECT concat(urn, '#', CASE data_type WHEN 'VARCHAR' THEN 'a' ELSE 'b' END) AS id, capsule_urn, urn AS column_urn, name AS column_name,
          CASE substr(name, 1, 4) WHEN 'emai' THEN 'pattern_match' WHEN 'phon' THEN 'not_null' WHEN 'amou' THEN 'range_check'
            WHEN 'orde' THEN 'referential_integrity' WHEN 'crea' THEN 'freshness' ELSE 'unique' END AS rule_type,
          CASE substr(name, 1, 4) WHEN 'emai' THEN 'validity' WHEN 'phon' THEN 'completeness' WHEN 'amou' THEN 'validity'
            WHEN 'orde' THEN 'consistency' WHEN 'crea' THEN 'timeliness' ELSE 'uniqueness' END AS rule_category,
          variant > 1 AS is_enabled, variant > 4 AS blocking,
          CASE WHEN variant > 3 THEN 'error' ELSE 'warning' END AS severity,
          CAST(80 + 3 * variant AS DOUBLE) AS last_score
        FROM v_columns WHERE variant < 6""",
    "v_profile_runs": """
        SELECT concat('urn:cat:part:', CAST(l_partkey AS STRING), '.', c.name, CAST(l_suppkey % 7 AS STRING)) AS column_urn,
          concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS capsule_urn, l_shipdate AS profiled_at,
          100 - max(l_tax) * 100 AS completeness_score, 100 - max(l_discount) * 100 AS validity_score, 40 + max(l_quantity) AS uniqueness_score,
          max(l_tax) * 100 AS null_percentage, 2 * max(l_quantity) AS unique_percentage
        FROM lineitem JOIN (SELECT 0 AS k, 'email_' AS name UNION ALL SELECT 1, 'phone_hash_' UNION ALL SELECT 2, 'amount_'
          UNION ALL SELECT 3, 'order_status_' UNION ALL SELECT 4, 'created_at_' UNION ALL SELECT 5, 'ssn_') c ON c.k = l_linenumber % 6
        GROUP BY 1, 2, 3""",
    "v_profiles": """
        SELECT column_urn, capsule_urn, min(completeness_score) AS completeness_score, min(validity_score) AS validity_score,
          max(uniqueness_score) AS uniqueness_score, max(null_percentage) AS null_percentage, max(unique_percentage) AS unique_percentage
        FROM v_profile_runs GROUP BY column_urn, capsule_urn""",
    "v_policies": """
        SELECT concat('policy:', CAST(p_partkey AS STRING)) AS id, concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          CASE p_size % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'restricted' ELSE 'secret' END AS sensitivity_level,
          CASE WHEN p_size % 4 = 1 THEN NULL ELSE 30 * p_size END AS retention_days,
          p_size % 10 = 0 AS legal_hold,
          CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'employee' END AS min_access_level,
          CASE WHEN p_size % 6 = 0 THEN '' ELSE 'analyst,admin' END AS allowed_roles_csv,
          CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'GDPR' ELSE 'GDPR,CCPA' END AS frameworks_csv,
          CASE WHEN p_size % 5 = 2 THEN '' ELSE 'EU,US' END AS allowed_regions_csv,
          CASE WHEN p_size % 7 = 0 THEN 'gdpr' ELSE 'finance' END AS classification_csv,
          p_size % 2 = 0 AS cross_border_transfer, p_size % 3 = 1 AS requires_masking, p_size % 4 > 1 AS encryption_required,
          CASE WHEN p_size % 8 = 0 THEN 'deprecated' WHEN p_size % 8 = 1 THEN 'draft' ELSE 'active' END AS policy_status,
          CAST(CASE WHEN p_size % 2 = 0 THEN '2001-08-15' ELSE '2002-01-31' END AS DATE) AS next_review_date,
          CAST('1999-01-01' AS DATE) AS effective_from,
          CAST(CASE WHEN p_size % 9 = 4 THEN '2000-12-31' ELSE '2010-12-31' END AS DATE) AS effective_to
        FROM part WHERE p_type <> 'STANDARD'""",
    "v_masking_rules": """
        SELECT concat(urn, '#mask') AS id, urn AS column_urn, capsule_urn,
          CASE variant WHEN 0 THEN 'redaction' WHEN 1 THEN 'hashing' WHEN 2 THEN 'tokenization' WHEN 3 THEN 'encryption' ELSE 'partial_redaction' END AS masking_method,
          variant <> 5 AS is_enabled, variant > 1 AND variant < 4 AS is_reversible,
          CASE WHEN variant % 2 = 0 THEN 'analyst,developer' ELSE '' END AS roles_csv,
          CASE WHEN variant % 3 = 0 THEN 'admin' ELSE '' END AS exempt_csv,
          CASE WHEN variant = 4 THEN 'region = 1' ELSE NULL END AS apply_condition,
          variant = 4 AS preserve_length
        FROM v_columns WHERE substr(name, 1, 4) = 'ssn_' OR (substr(name, 1, 6) = 'email_' AND variant > 2)""",
    "v_versions": """
        SELECT concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS capsule_urn, l_linenumber AS version_number,
          CASE WHEN l_linenumber = 1 THEN 'created' WHEN max(l_tax) > 0.06 THEN 'schema_change' ELSE 'metadata_change' END AS change_type,
          CASE WHEN min(l_discount) > 0.0 THEN 'changed' ELSE NULL END AS change_summary,
          max(l_tax) > 0.07 AS breaking_change,
          CASE WHEN max(l_quantity) > 25 THEN concat('sha', CAST(l_linenumber AS STRING)) ELSE NULL END AS git_commit_sha,
          max(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_partkey, l_linenumber""",
    "v_code": """
        SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          CASE p_size % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' WHEN 2 THEN 'dbt' ELSE 'scala' END AS language,
          concat('models/', lower(p_type), '/', CAST(p_partkey AS STRING), '.sql') AS file_path,
          CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS line_start,
          CASE WHEN p_size % 2 = 0 THEN concat('sha', CAST(p_size AS STRING)) ELSE NULL END AS git_commit_sha
        FROM part WHERE p_size > 10""",
    "v_contracts": """
        SELECT concat('contract:', CAST(p_partkey AS STRING)) AS id, concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          CASE p_size % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'proposed' WHEN 2 THEN 'deprecated' ELSE 'active' END AS contract_status,
          CASE WHEN p_size % 4 = 0 THEN NULL ELSE 24 * p_size END AS freshness_hours,
          CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(0.9 AS DOUBLE) END AS completeness_sla,
          CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(0.95 AS DOUBLE) END AS quality_score_sla,
          CASE WHEN p_size % 9 = 0 THEN 10 ELSE NULL END AS row_count_min,
          CASE WHEN p_size % 2 = 0 THEN 'best_effort' ELSE '24x7' END AS support_level,
          CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'data@example.com' END AS support_contact,
          concat('owner_', CAST(p_size % 11 AS STRING)) AS contract_owner,
          CASE WHEN p_size % 10 = 0 THEN CAST('2001-06-30' AS DATE) ELSE NULL END AS deprecation_date
        FROM part WHERE p_type <> 'PROMO'""",
    "v_incidents": """
        SELECT concat('incident:', CAST(event_id AS STRING)) AS id, concat('contract:', CAST(user_id AS STRING)) AS contract_id,
          concat('urn:cat:part:', CAST(user_id AS STRING)) AS capsule_urn,
          CASE event_type WHEN 'view' THEN 'freshness' WHEN 'click' THEN 'completeness' WHEN 'error' THEN 'availability' WHEN 'signup' THEN 'quality' ELSE 'latency' END AS incident_type,
          CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS incident_severity,
          CASE WHEN value < 20 THEN 'open' WHEN value < 40 THEN 'investigating' WHEN value > 300 THEN 'open' WHEN value < 80 THEN 'false_positive' ELSE 'resolved' END AS incident_status,
          CASE WHEN value > 30 THEN 'upstream' ELSE NULL END AS root_cause_category,
          ts AS detected_at, CASE WHEN value > 10 THEN ts ELSE NULL END AS acknowledged_at
        FROM events""",
    "v_terms": """
        SELECT concat('term:', n_name) AS term, CONCAT('domain:', r_name) AS domain, n_name AS term_name,
          CASE WHEN n_regionkey % 2 = 0 THEN 'geography' ELSE 'trade' END AS category,
          CASE n_regionkey WHEN 0 THEN 'draft' WHEN 1 THEN 'under_review' ELSE 'approved' END AS approval_status
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "v_capsule_terms": """
        SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn, concat('term:', n_name) AS term
        FROM part JOIN nation ON n_nationkey = p_size""",
    "v_column_terms": """
        SELECT urn AS column_urn, capsule_urn, concat('term:NATION_', CAST(variant AS STRING)) AS term
        FROM v_columns WHERE data_type = 'DECIMAL' OR (data_type = 'TIMESTAMP' AND variant > 3)""",
    "v_column_domains": """
        SELECT urn AS column_urn, capsule_urn, 'order_status' AS value_domain
        FROM v_columns WHERE substr(name, 1, 6) = 'order_' AND variant > 2""",
    "v_tags": """
        SELECT DISTINCT p_brand AS tag, 'brand' AS category, CASE WHEN p_brand < 'Brand#2' THEN 'public' ELSE 'internal' END AS sensitivity_level FROM part
        UNION ALL SELECT DISTINCT lower(p_type), 'kind', 'public' FROM part""",
    "v_capsule_tags": """
        SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn, p_brand AS tag FROM part WHERE p_size % 6 <> 0
        UNION ALL SELECT concat('urn:cat:part:', CAST(p_partkey AS STRING)), lower(p_type) FROM part WHERE p_size % 6 <> 0""",
    "v_column_tags": """
        SELECT urn AS column_urn, capsule_urn, CASE data_type WHEN 'VARCHAR' THEN 'small' ELSE 'large' END AS tag FROM v_columns WHERE variant > 1""",
    "v_data_products": """
        SELECT DISTINCT p_brand AS product, lower(p_type) AS domain, concat('owner_', p_brand) AS owner,
          CASE lower(p_type) WHEN 'economy' THEN 'draft' WHEN 'small' THEN 'deprecated' ELSE 'active' END AS status
        FROM part""",
    "v_product_members": """
        SELECT p_brand AS product, concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          CASE p_size % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'input' ELSE 'member' END AS role
        FROM part""",
    "v_products": """
        SELECT p_brand AS product, concat('urn:cat:part:', CAST(p_partkey AS STRING)) AS capsule_urn,
          max(l_shipdate) AS updated_at, sum(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS open_violations
        FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""",
    "v_domain_tree": """
        SELECT r_name AS domain, CAST(NULL AS STRING) AS parent FROM region
        UNION ALL SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "v_domain_members": """
        SELECT concat('customer:', CAST(c_custkey AS STRING)) AS capsule_urn, n_name AS domain
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'MACHINERY'""",
    "v_owners": """
        SELECT s_name AS owner, CASE WHEN s_acctbal > 5000 THEN 'team' ELSE 'user' END AS owner_type FROM supplier""",
    "v_value_domains": """
        SELECT DISTINCT concat('domain_', o_orderpriority) AS domain_name,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'enum' WHEN '2' THEN 'pattern' WHEN '3' THEN 'range' ELSE 'reference_data' END AS domain_type,
          CASE WHEN o_orderpriority < '3' THEN 'owner_1' ELSE 'owner_2' END AS owner, o_orderpriority > '4' AS is_extensible
        FROM orders""",
    # -------------------------------------------------------------- edges
    "v_edges": """
        SELECT concat('region:', CAST(n_regionkey AS STRING)) AS source_urn, concat('nation:', CAST(n_nationkey AS STRING)) AS target_urn FROM nation
        UNION ALL SELECT concat('nation:', CAST(c_nationkey AS STRING)), concat('customer:', CAST(c_custkey AS STRING)) FROM customer
        UNION ALL SELECT concat('nation:', CAST(s_nationkey AS STRING)), concat('supplier:', CAST(s_suppkey AS STRING)) FROM supplier
        UNION ALL SELECT concat('customer:', CAST(o_custkey AS STRING)), concat('order:', CAST(o_orderkey AS STRING)) FROM orders
        UNION ALL SELECT DISTINCT concat('supplier:', CAST(l_suppkey AS STRING)), concat('order:', CAST(l_orderkey AS STRING)) FROM lineitem""",
    "v_edges_cyclic": """
        SELECT source_urn, target_urn FROM v_edges
        UNION ALL SELECT DISTINCT concat('order:', CAST(o_orderkey AS STRING)), concat('nation:', CAST(c_nationkey AS STRING))
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "v_nation_seeds": "SELECT concat('nation:', CAST(n_nationkey AS STRING)) AS seed FROM nation",
    "v_users": """
        SELECT DISTINCT concat('u:', CAST(user_id AS STRING)) AS source_urn, concat('u:', CAST(nxt AS STRING)) AS target_urn
        FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS nxt FROM events) t
        WHERE nxt IS NOT NULL AND nxt <> user_id""",
    "v_capsule_edges": """
        SELECT DISTINCT concat('urn:cat:part:', CAST(l_suppkey AS STRING)) AS source_urn, concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS target_urn,
          CASE WHEN l_suppkey % 5 = 0 THEN 'references' ELSE 'flows_to' END AS edge_type
        FROM lineitem WHERE l_suppkey <> l_partkey""",
    "v_column_nodes": """
        SELECT concat('nation:', CAST(n_nationkey AS STRING), '.contact_email') AS urn, concat('nation:', CAST(n_nationkey AS STRING)) AS capsule_urn,
          'contact_email' AS name, 'VARCHAR' AS data_type, 'bronze' AS layer FROM nation
        UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING), '.email'), concat('customer:', CAST(c_custkey AS STRING)), 'email', 'VARCHAR', 'silver' FROM customer
        UNION ALL SELECT concat('order:', CAST(o_orderkey AS STRING), CASE o_orderstatus WHEN 'F' THEN '.customer_email_hash' ELSE '.customer_email' END),
          concat('order:', CAST(o_orderkey AS STRING)), CASE o_orderstatus WHEN 'F' THEN 'customer_email_hash' ELSE 'customer_email' END, 'VARCHAR', 'gold' FROM orders
        UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING), '.billing_email'), concat('supplier:', CAST(s_suppkey AS STRING)), 'billing_email', 'TEXT', 'marts' FROM supplier""",
    "v_column_edges": """
        SELECT concat('nation:', CAST(c_nationkey AS STRING), '.contact_email') AS source_column_urn, concat('customer:', CAST(c_custkey AS STRING), '.email') AS target_column_urn,
          'derives_from' AS edge_type, 'identity' AS transformation_type, CAST(NULL AS STRING) AS transformation_logic, CAST(1.0 AS DOUBLE) AS confidence, 'sql_parser' AS detected_by FROM customer
        UNION ALL SELECT concat('customer:', CAST(o_custkey AS STRING), '.email'), concat('order:', CAST(o_orderkey AS STRING), CASE o_orderstatus WHEN 'F' THEN '.customer_email_hash' ELSE '.customer_email' END),
          'derives_from', CASE o_orderstatus WHEN 'F' THEN 'hash' WHEN 'O' THEN 'identity' ELSE 'cast' END,
          CASE o_orderstatus WHEN 'F' THEN 'sha2(email, 256)' WHEN 'O' THEN NULL ELSE 'cast(email as text)' END,
          CASE o_orderstatus WHEN 'O' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END, 'sql_parser' FROM orders
        UNION ALL SELECT DISTINCT concat('order:', CAST(l_orderkey AS STRING), CASE o_orderstatus WHEN 'F' THEN '.customer_email_hash' ELSE '.customer_email' END),
          concat('supplier:', CAST(l_suppkey AS STRING), '.billing_email'), 'derives_from', 'aggregate', 'max(customer_email)', CAST(0.95 AS DOUBLE), 'sql_parser'
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "v_task_column_edges": """
        SELECT DISTINCT concat('urn:cat:task:', CAST(l_suppkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS task_urn,
          concat('customer:', CAST(o_custkey AS STRING), '.email') AS column_urn,
          CASE l_linenumber % 2 WHEN 0 THEN 'writes' ELSE 'reads' END AS edge_type
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    # ------------------------------------------------------ orchestration
    "v_workflows": """
        SELECT concat('urn:cat:pipeline:', CAST(s_suppkey AS STRING)) AS urn, s_name AS name,
          CASE s_suppkey % 6 WHEN 0 THEN '@hourly' WHEN 1 THEN '@daily' WHEN 2 THEN '0 */6 * * *' WHEN 3 THEN '30 2,14 * * *' WHEN 4 THEN '@once' ELSE '15 9 * * 1' END AS schedule_interval,
          CASE WHEN s_acctbal > 5000 THEN 'airflow_dag' ELSE 'dbt_project' END AS pipeline_type,
          concat('system_', CAST(s_nationkey % 3 AS STRING)) AS source_system,
          s_acctbal > 7000 AS is_paused, s_acctbal > 1000 AS is_active
        FROM supplier""",
    "v_tasks": """
        SELECT DISTINCT concat('urn:cat:task:', CAST(l_suppkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS task_urn,
          concat('task_', CAST(l_linenumber AS STRING)) AS name, concat('urn:cat:pipeline:', CAST(l_suppkey AS STRING)) AS pipeline_urn
        FROM lineitem""",
    "v_task_edges": """
        SELECT concat('urn:cat:task:', CAST(l_suppkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS task_urn,
          concat('urn:cat:pipeline:', CAST(l_suppkey AS STRING)) AS pipeline_urn,
          concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS capsule_urn,
          CASE l_linenumber % 4 WHEN 0 THEN 'produces' WHEN 1 THEN 'consumes' WHEN 2 THEN 'transforms' ELSE 'validates' END AS edge_type,
          max(l_discount) * 10 AS criticality_score, 100 - max(l_tax) * 100 AS success_rate
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_order_task_edges": """
        SELECT concat('urn:cat:task:', CAST(l_suppkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS task_urn,
          concat('urn:cat:pipeline:', CAST(l_suppkey AS STRING)) AS pipeline_urn, concat('order:', CAST(l_orderkey AS STRING)) AS capsule_urn,
          CASE l_linenumber % 4 WHEN 0 THEN 'produces' WHEN 1 THEN 'consumes' WHEN 2 THEN 'transforms' ELSE 'validates' END AS edge_type,
          max(l_discount) * 10 AS criticality_score, 100 - max(l_tax) * 100 AS success_rate
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_task_order": """
        SELECT a.task_urn AS source_task_urn, b.task_urn AS target_task_urn, a.pipeline_urn AS pipeline_urn
        FROM v_tasks a JOIN v_tasks b ON a.pipeline_urn = b.pipeline_urn AND CAST(substr(b.name, 6, 3) AS INTEGER) = CAST(substr(a.name, 6, 3) AS INTEGER) + 1""",
    "v_task_dependencies": """
        SELECT concat('dag_', CAST(l_suppkey AS STRING)) AS dag_id, concat('task_', CAST(l_linenumber AS STRING)) AS task_id,
          concat('urn:cat:part:', CAST(l_partkey AS STRING)) AS capsule_urn,
          CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'transform' END AS dependency_type,
          max(l_discount) * 10 AS criticality_score, min(l_quantity) > 5 AS is_active, CAST(max(l_quantity) * 10 AS INTEGER) AS avg_execution_duration_seconds
        FROM lineitem GROUP BY l_suppkey, l_linenumber, l_partkey""",
    # ------------------------------------------------------- event history
    "v_violations": """
        SELECT event_id AS id, concat('R', CAST(event_id % 9 AS STRING)) AS rule_id, user_id AS subject,
          CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity,
          CASE WHEN value < 40 THEN 'resolved' ELSE 'open' END AS status, ts AS detected_at,
          concat('ingest_', CAST(user_id % 4 AS STRING)) AS ingestion_id
        FROM events""",
    "v_rules": """
        SELECT DISTINCT concat('R', CAST(event_id % 9 AS STRING)) AS rule_id,
          CASE event_id % 9 WHEN 0 THEN 'naming' WHEN 1 THEN 'lineage' WHEN 2 THEN 'pii' WHEN 3 THEN 'quality' ELSE 'policy' END AS category,
          CASE WHEN event_id % 9 < 4 THEN 'set_a' ELSE 'set_b' END AS rule_set,
          CASE WHEN event_id % 9 = 8 THEN 'column' ELSE 'capsule' END AS scope, event_id % 9 <> 5 AS enabled
        FROM events""",
    "v_changes": """
        SELECT event_id AS change_id, concat('urn:cat:part:', CAST(user_id AS STRING), '.email_0') AS column_urn,
          CASE event_type WHEN 'view' THEN 'delete' WHEN 'click' THEN 'rename' WHEN 'error' THEN 'type_change' WHEN 'signup' THEN 'nullability' ELSE 'default' END AS change_type,
          CASE WHEN value > 300 THEN NULL WHEN value < 60 THEN true ELSE false END AS success,
          CASE WHEN value > 200 THEN NULL ELSE CAST(floor(value * 10) AS INTEGER) END AS actual_downtime_seconds,
          CASE WHEN value > 150 THEN 'timeout,rollback' WHEN value > 60 THEN 'schema drift' ELSE NULL END AS issues_csv,
          ts AS change_timestamp
        FROM events""",
    "v_alerts": """
        SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'high_risk' WHEN 'click' THEN 'production_impact' WHEN 'error' THEN 'pii_change' ELSE 'breaking_change' END AS alert_type,
          CASE WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity,
          concat('urn:cat:part:', CAST(user_id AS STRING), '.email_0') AS column_urn, value < 50 AS resolved, value < 90 AS acknowledged, ts AS created_at
        FROM events""",
    # ---------------------------------------------------------- snapshots
    "v_snapshot_old": "SELECT o_orderkey AS urn, o_orderstatus AS v, o_orderdate AS updated FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "v_snapshot_new": "SELECT o_orderkey AS urn, CASE o_orderstatus WHEN 'P' THEN 'X' ELSE o_orderstatus END AS v, o_orderdate AS updated FROM orders WHERE o_orderpriority <> '5-LOW'",
    "v_schema_old": "SELECT urn, capsule_urn, name, data_type FROM v_columns WHERE variant <> 2",
    "v_schema_new": "SELECT urn, capsule_urn, name, CASE WHEN variant = 5 THEN 'TEXT' ELSE data_type END AS data_type FROM v_columns WHERE variant <> 4",
    "v_service_contracts": """
        SELECT concat('customer:', CAST(c_custkey AS STRING)) AS subject, CAST(24 * (1 + c_nationkey % 30) AS BIGINT) AS freshness_hours,
          CAST(c_custkey % 5 AS BIGINT) AS row_count_min, CAST(5 + c_nationkey % 9 AS BIGINT) AS row_count_max,
          CAST(0.5 AS DOUBLE) AS completeness_sla, CAST(0.6 AS DOUBLE) AS quality_score_sla FROM customer""",
    # ------------------------------------------------------ warehouse rows
    "v_wh_tables": """
        SELECT 'PROD' AS database_name, CASE l_linenumber % 4 WHEN 0 THEN 'RAW_SALES' WHEN 1 THEN 'STAGING' WHEN 2 THEN 'MARTS' ELSE 'INFORMATION_SCHEMA' END AS schema_name,
          concat('T', CAST(l_partkey AS STRING)) AS table_name,
          CASE l_linenumber % 4 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'MATERIALIZED VIEW' ELSE 'EXTERNAL TABLE' END AS table_type,
          max(l_shipdate) AS last_altered
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_wh_columns": """
        SELECT DISTINCT 'PROD' AS database_name, CASE l_linenumber % 4 WHEN 0 THEN 'RAW_SALES' WHEN 1 THEN 'STAGING' WHEN 2 THEN 'MARTS' ELSE 'INFORMATION_SCHEMA' END AS schema_name,
          concat('T', CAST(l_partkey AS STRING)) AS table_name,
          CASE l_suppkey % 7 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE_NO' WHEN 2 THEN 'CITY' WHEN 3 THEN 'SSN' WHEN 4 THEN 'USERNAME' WHEN 5 THEN 'IP_ADDR' ELSE 'AMOUNT' END AS column_name,
          CASE l_suppkey % 7 WHEN 0 THEN 'VARCHAR(16)' WHEN 1 THEN 'NUMBER(38,0)' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'VARIANT' WHEN 4 THEN 'OBJECT' WHEN 5 THEN 'TIMESTAMP_LTZ(9)' ELSE 'NUMBER(10,2)' END AS data_type,
          CASE WHEN l_suppkey % 7 < 3 THEN 'YES' ELSE 'NO' END AS is_nullable
        FROM lineitem""",
    "v_wh_tags": """
        SELECT DISTINCT database_name AS object_database, schema_name AS object_schema, table_name AS object_name, column_name,
          CASE column_name WHEN 'EMAIL' THEN 'pii' WHEN 'AMOUNT' THEN 'Measure' WHEN 'SSN' THEN 'Sensitive' ELSE 'PII' END AS tag_name,
          CASE column_name WHEN 'PHONE_NO' THEN 'phone' WHEN 'IP_ADDR' THEN 'IP_ADDRESS' ELSE NULL END AS tag_value
        FROM v_wh_columns""",
    # --------------------------------- documents as tables of distinct words
    "v_doc_capsules": """
        SELECT concat('doc:', CAST(doc_id AS STRING)) AS urn, concat(lang, '_', source) AS name, 'document' AS capsule_type, lang AS layer, source AS domain
        FROM documents""",
    "v_doc_edges": "SELECT source AS source_urn, concat('doc:', CAST(doc_id AS STRING)) AS target_urn, 'flows_to' AS edge_type FROM documents",
}

#: views that read the large tables with a join, a grouping or a distinct, and that several queries or several parts of one query use
WRITTEN = frozenset({
    "v_columns", "v_profile_runs", "v_profiles", "v_versions", "v_capsule_edges", "v_tasks", "v_task_edges", "v_order_task_edges", "v_task_dependencies",
    "v_task_column_edges", "v_column_edges", "v_edges", "v_edges_cyclic", "v_users", "v_products", "v_wh_tables", "v_wh_columns",
})

_REFERENCE = re.compile(r"\bv_[a-z_]+\b")


def required_views(*names: str) -> list[str]:
    """``names`` and everything they refer to, in an order that defines before use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in sorted(set(_REFERENCE.findall(VIEWS[name])) - {name}):
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_clause(*names: str) -> str:
    """The ``WITH`` prefix that defines the views ``names`` need."""
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in required_views(*names))


def bodies(name: str) -> dict[str, str | None]:
    """What ``name`` is made of, in an order that defines before use: the SQL of inlined views, None for written ones."""
    out: dict[str, str | None] = {}

    def visit(view: str) -> None:
        if view in out:
            return
        if view != name and view in WRITTEN:
            out[view] = None
            return
        for dependency in sorted(set(_REFERENCE.findall(VIEWS[view])) - {view}):
            visit(dependency)
        out[view] = VIEWS[view]

    visit(name)
    return out


def views_in(sql: str) -> list[str]:
    """The views a statement mentions, in first-use order."""
    return [n for n in dict.fromkeys(_REFERENCE.findall(sql)) if n in VIEWS]
