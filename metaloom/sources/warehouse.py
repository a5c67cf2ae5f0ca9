"""Warehouse metadata exports: tables, columns, access log, view definitions, tags.

Inputs are DataFrames of exported rows (parquet, or JDBC reads split by a
partition column); every database and table is handled in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.classify import infer_pii_type, layer_of_schema, standard_type, table_kind, tag_types
from metaloom.operators.rollups import latest_per_key

# Schemas never read, table types, object kinds of the access log
SYSTEM_SCHEMAS = ["INFORMATION_SCHEMA", "ACCOUNT_USAGE"]
BASE_TABLE = "BASE TABLE"
OPTIONAL_TYPES = {"views": "VIEW", "materialized_views": "MATERIALIZED VIEW", "external_tables": "EXTERNAL TABLE"}
LOGGED_DOMAINS = ["Table", "View", "Materialized view"]
#: FROM or JOIN, then up to three dotted identifiers with optional quotes
REFERENCE = r'(?i)\b(?:from|join)\s+((?:"?\w+"?\s*\.\s*){0,2}"?\w+"?)'
WRITTEN = r'(?i)\b(?:insert\s+(?:overwrite\s+)?into|insert\s+overwrite\s+table|merge\s+into|update|create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table(?:\s+if\s+not\s+exists)?)\s+((?:"?\w+"?\s*\.\s*){0,2}"?\w+"?)'


def tables(rows: DataFrame, schemas: Sequence[str] | None = None, since: str | None = None, views: bool = True,
           materialized_views: bool = True, external_tables: bool = True) -> DataFrame:
    """User tables by schema, type and change time; all conditions reach the scan.

    ``since`` is the start time of the last sync.
    """
    wanted = {"views": views, "materialized_views": materialized_views, "external_tables": external_tables}
    types = [BASE_TABLE] + [t for name, t in OPTIONAL_TYPES.items() if wanted[name]]
    kept = rows.filter(~F.col("schema_name").isin(SYSTEM_SCHEMAS) & F.col("table_type").isin(types))
    if schemas:
        kept = kept.filter(F.col("schema_name").isin(list(schemas)))
    return kept if since is None else kept.filter(F.col("last_altered") > F.lit(since).cast("timestamp_ntz"))


def columns(rows: DataFrame, schemas: Sequence[str] | None = None) -> DataFrame:
    """Column rows of user tables, all tables in one scan."""
    kept = rows.filter(~F.col("schema_name").isin(SYSTEM_SCHEMAS))
    return kept.filter(F.col("schema_name").isin(list(schemas))) if schemas else kept


def _table_urn(prefix: str, kind: Column, database: Column, schema: Column, name: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), kind, F.lit(":"), database, F.lit("."), schema, F.lit(":"), name)


def column_urn(prefix: str, database: Column, schema: Column, table: Column, column: Column) -> Column:
    return F.concat(F.lit(prefix + ":column:"), database, F.lit("."), schema, F.lit(":"), table, F.lit("."), column)


def capsules(table_rows: DataFrame, prefix: str = "urn:cat:warehouse") -> DataFrame:
    """Catalog rows of warehouse tables."""
    d, s, t = F.col("database_name"), F.col("schema_name"), F.col("table_name")
    kind = table_kind(F.col("table_type"))
    return table_rows.select(
        _table_urn(prefix, kind, d, s, t).alias("urn"), t.alias("name"), kind.alias("capsule_type"), F.concat_ws(".", d, s, t).alias("unique_id"),
        d.alias("database_name"), s.alias("schema_name"), layer_of_schema(s).alias("layer"),
    )


def catalog_columns(column_rows: DataFrame, table_capsules: DataFrame, prefix: str = "urn:cat:warehouse") -> DataFrame:
    """Catalog rows of the columns of known tables."""
    known = table_capsules.select("database_name", "schema_name", F.col("name").alias("table_name"), F.col("urn").alias("capsule_urn"))
    d, s, t, c = (F.col(x) for x in ("database_name", "schema_name", "table_name", "column_name"))
    return column_rows.join(known, ["database_name", "schema_name", "table_name"]).select(
        column_urn(prefix, d, s, t, c).alias("urn"), "capsule_urn", c.alias("name"), standard_type(F.coalesce("data_type", F.lit(""))).alias("data_type"),
        (F.coalesce("is_nullable", F.lit("YES")) == "YES").alias("is_nullable"),
    )


def access_lineage(log: DataFrame, table_capsules: DataFrame, now: str, lookback_days: int = 7) -> DataFrame:
    """Edges base object → modified object with query counts.

    log (query_id, query_start_time, base_objects_accessed, objects_modified),
    the object lists as arrays of struct(objectName, objectDomain).  Self edges
    and objects outside the catalog are dropped; the whole log is read.
    """
    recent = log.filter(F.col("query_start_time") >= F.expr(f"timestamp_ntz'{now}' - interval {int(lookback_days)} days"))
    bases = recent.select("query_id", "query_start_time", F.explode("base_objects_accessed").alias("b"), "objects_modified")
    pairs = bases.select("query_id", "query_start_time", "b", F.explode("objects_modified").alias("m"))
    pairs = pairs.filter(F.col("b.objectDomain").isin(LOGGED_DOMAINS) & F.col("m.objectDomain").isin(LOGGED_DOMAINS))
    named = pairs.select("query_id", "query_start_time", F.col("b.objectName").alias("s"), F.col("m.objectName").alias("t")).filter(F.col("s") != F.col("t"))
    counted = named.groupBy("s", "t").agg(F.count_distinct("query_id").alias("query_count"), F.max("query_start_time").alias("last_query_time"))
    known = table_capsules.groupBy(F.col("unique_id").alias("_id")).agg(F.min("urn").alias("_urn"))
    source = known.select(F.col("_id").alias("s"), F.col("_urn").alias("source_urn"))
    target = known.select(F.col("_id").alias("t"), F.col("_urn").alias("target_urn"))
    return counted.join(source, "s").join(target, "t").select(
        "source_urn", "target_urn", F.lit("flows_to").alias("edge_type"), F.lit("query").alias("transformation"), "query_count", "last_query_time"
    )


def plain_sql(text: Column) -> Column:
    """SQL text without comments, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def references(rows: DataFrame, key: str, sql: str, database: Column, schema: Column, pattern: str = REFERENCE) -> DataFrame:
    """(key, ref_database, ref_schema, ref_table): distinct upper-case names a SQL text refers to.

    Missing parts come from the defaults; two-part names are schema.table.
    """
    found = rows.select(F.col(key), database.alias("_d"), schema.alias("_s"), F.explode(F.regexp_extract_all(plain_sql(F.col(sql)), F.lit(pattern), F.lit(1))).alias("_r"))
    parts = F.split(F.upper(F.regexp_replace("_r", r'["\s]', "")), r"\.")
    n = F.size(parts)
    return found.select(
        F.col(key), F.when(n == 3, parts[0]).otherwise(F.upper("_d")).alias("ref_database"),
        F.when(n >= 2, F.get(parts, n - 2)).otherwise(F.upper("_s")).alias("ref_schema"), F.get(parts, n - 1).alias("ref_table"),
    ).distinct()


def _match(refs: DataFrame, table_capsules: DataFrame) -> DataFrame:
    """References joined with tables and views of that name, without case."""
    known = table_capsules.select(
        F.upper("database_name").alias("ref_database"), F.upper("schema_name").alias("ref_schema"), F.upper("name").alias("ref_table"), F.col("urn").alias("ref_urn")
    )
    return refs.join(known, ["ref_database", "ref_schema", "ref_table"])


def view_lineage(ddl: DataFrame, table_capsules: DataFrame) -> DataFrame:
    """Edges from the tables and views a view definition reads.

    ddl (database_name, schema_name, view_name, ddl).
    """
    views = table_capsules.filter(F.col("capsule_type").isin("view", "materialized_view"))
    known = views.select("database_name", "schema_name", F.col("name").alias("view_name"), F.col("urn").alias("target_urn"))
    texts = ddl.join(known, ["database_name", "schema_name", "view_name"])
    refs = references(texts, "target_urn", "ddl", F.col("database_name"), F.col("schema_name"))
    edges = _match(refs, table_capsules).filter(F.col("ref_urn") != F.col("target_urn"))
    return edges.select(F.col("ref_urn").alias("source_urn"), "target_urn", F.lit("flows_to").alias("edge_type"), F.lit("view_definition").alias("transformation")).distinct()


def task_sql_edges(task_sql: DataFrame, table_capsules: DataFrame, database: str = "", schema: str = "public") -> DataFrame:
    """(task_urn, capsule_urn, edge_type) from task SQL: tables read are consumed, tables written are produced.

    task_sql (task_urn, sql).
    """
    reads = references(task_sql, "task_urn", "sql", F.lit(database), F.lit(schema)).withColumn("edge_type", F.lit("consumes"))
    writes = references(task_sql, "task_urn", "sql", F.lit(database), F.lit(schema), WRITTEN).withColumn("edge_type", F.lit("produces"))
    return _match(reads.unionByName(writes), table_capsules).select("task_urn", F.col("ref_urn").alias("capsule_urn"), "edge_type").distinct()


def apply_tags(catalog_cols: DataFrame, tag_rows: DataFrame, prefix: str = "urn:cat:warehouse",
               custom: Mapping[str, tuple[str, str | None, bool]] | None = None) -> DataFrame:
    """Columns with semantic and PII type from warehouse tags.

    Only live column tags count; of several tags with a type the one with the
    greatest name decides.  A plain PII tag takes its type from the column name.
    """
    live = tag_rows.filter(F.col("column_name").isNotNull())
    for dropped in ("object_deleted", "tag_dropped"):
        if dropped in live.columns:
            live = live.filter(F.col(dropped).isNull())
    urn = column_urn(prefix, F.col("object_database"), F.col("object_schema"), F.col("object_name"), F.col("column_name"))
    typed = live.select(urn.alias("urn"), "tag_name", "column_name", tag_types(F.col("tag_name"), F.col("tag_value"), custom).alias("m"))
    inferred = F.when(F.col("m.infer"), infer_pii_type(F.col("column_name")))
    mapped = typed.filter(F.col("m.semantic_type").isNotNull()).select(
        "urn", "tag_name", F.col("m.semantic_type").alias("tag_semantic"), F.coalesce("m.pii_type", inferred).alias("pii_type"),
        F.when(F.col("m.pii_type").isNotNull(), "snowflake_tag").when(inferred.isNotNull(), "snowflake_tag_inferred").alias("pii_detected_by"),
    )
    best = latest_per_key(mapped, ["urn"], "tag_name").drop("tag_name")
    return catalog_cols.join(best, "urn", "left").withColumnRenamed("tag_semantic", "semantic_type")
