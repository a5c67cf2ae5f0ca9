"""Classification of tables, columns, tasks and expressions as Column expressions.

All functions are built from native expressions, so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Word lists, patterns and tables that decide results
# ---------------------------------------------------------------------------

PII_NAME_PATTERNS: dict[str, list[str]] = {
    "email": [
        r"(?:^|_)e?mail(?:_|$)", r"(?:^|_)email_address(?:_|$)",
        r"(?:^|_)user_email(?:_|$)", r"(?:^|_)customer_email(?:_|$)",
    ],
    "phone": [
        r"(?:^|_)phone(?:_|$)", r"(?:^|_)mobile(?:_|$)", r"(?:^|_)cell(?:_|$)",
        r"(?:^|_)telephone(?:_|$)", r"(?:^|_)tel(?:_|$)", r"(?:^|_)phone_number(?:_|$)",
    ],
    "ssn": [
        r"(?:^|_)ssn(?:_|$)", r"(?:^|_)social_security(?:_|$)", r"(?:^|_)social_security_number(?:_|$)",
    ],
    "address": [
        r"(?:^|_)address(?:_|$)", r"(?:^|_)street(?:_|$)", r"(?:^|_)city(?:_|$)", r"(?:^|_)zip(?:_|$)",
        r"(?:^|_)zip_code(?:_|$)", r"(?:^|_)postal(?:_|$)", r"(?:^|_)postal_code(?:_|$)",
        r"(?:^|_)state(?:_|$)", r"(?:^|_)country(?:_|$)",
    ],
    "name": [
        r"(?:^|_)first_name(?:_|$)", r"(?:^|_)last_name(?:_|$)", r"(?:^|_)full_name(?:_|$)",
        r"(?:^|_)customer_name(?:_|$)", r"(?:^|_)user_name(?:_|$)", r"(?:^|_)person_name(?:_|$)",
        r"(?:^|_)given_name(?:_|$)", r"(?:^|_)family_name(?:_|$)", r"(?:^|_)surname(?:_|$)",
    ],
    "date_of_birth": [
        r"(?:^|_)dob(?:_|$)", r"(?:^|_)birth_?date(?:_|$)", r"(?:^|_)date_of_birth(?:_|$)", r"(?:^|_)birthday(?:_|$)",
    ],
    "credit_card": [
        r"(?:^|_)credit_card(?:_|$)", r"(?:^|_)card_number(?:_|$)", r"(?:^|_)cc_num(?:_|$)",
        r"(?:^|_)card_num(?:_|$)", r"(?:^|_)pan(?:_|$)",
    ],
    "bank_account": [
        r"(?:^|_)bank_account(?:_|$)", r"(?:^|_)account_number(?:_|$)", r"(?:^|_)routing_number(?:_|$)",
        r"(?:^|_)iban(?:_|$)", r"(?:^|_)swift(?:_|$)",
    ],
    "ip_address": [
        r"(?:^|_)ip_addr(?:ess)?(?:_|$)", r"(?:^|_)client_ip(?:_|$)", r"(?:^|_)user_ip(?:_|$)", r"(?:^|_)source_ip(?:_|$)",
    ],
    "device_id": [
        r"(?:^|_)device_id(?:_|$)", r"(?:^|_)device_identifier(?:_|$)", r"(?:^|_)udid(?:_|$)",
        r"(?:^|_)idfa(?:_|$)", r"(?:^|_)gaid(?:_|$)",
    ],
}

#: looser substring groups used for warehouse tags, most specific first
PII_NAME_SUBSTRINGS: dict[str, list[str]] = {
    "ip_address": ["ip_address", "ip_addr"],
    "credit_card": ["credit_card", "cc_number", "card_number"],
    "email": ["email", "e_mail", "mail"],
    "phone": ["phone", "tel", "mobile", "cell"],
    "ssn": ["ssn", "social_security"],
    "name": ["first_name", "last_name", "full_name", "username"],
    "address": ["address", "addr", "street", "city", "state", "zip"],
}

LAYER_NAME_PATTERNS: dict[str, list[str]] = {
    "bronze": [r"^raw_", r"^source_", r"^src_", r"_raw$"],
    "silver": [r"^stg_", r"^staging_", r"^int_", r"^intermediate_", r"^base_", r"^prep_"],
    "gold": [r"^dim_", r"^fct_", r"^fact_", r"^mart_", r"^rpt_", r"^report_", r"^agg_", r"^metric_"],
}

LAYER_PATH_PATTERNS: dict[str, list[str]] = {
    "bronze": [r"/raw/", r"/sources/", r"/bronze/", r"/landing/"],
    "silver": [r"/staging/", r"/intermediate/", r"/silver/", r"/transform/", r"/prep/"],
    "gold": [r"/marts/", r"/gold/", r"/presentation/", r"/reports/", r"/analytics/", r"/core/"],
}

LAYER_TAGS: dict[str, str] = {
    "raw": "bronze", "bronze": "bronze", "landing": "bronze",
    "staging": "silver", "silver": "silver", "intermediate": "silver", "transform": "silver",
    "mart": "gold", "marts": "gold", "gold": "gold", "presentation": "gold", "analytics": "gold",
}

SCHEMA_LAYER_PATTERNS: dict[str, list[str]] = {
    "bronze": [r"^(raw|landing|bronze|stage|l1).*", r".*_raw$", r".*_landing$"],
    "silver": [r"^(staging|stg|silver|intermediate|int|l2).*", r".*_staging$", r".*_stg$"],
    "gold": [r"^(mart|marts|gold|analytics|prod|l3|presentation).*", r".*_(mart|marts)$", r".*_analytics$"],
}

NON_DOMAIN_FOLDERS = [
    "models", "staging", "intermediate", "marts", "raw", "sources", "reports",
    "analytics", "core", "base", "prep", "transform",
]

PII_SEVERITY: dict[str, str] = {
    "ssn": "critical", "national_id": "critical", "passport": "critical", "drivers_license": "critical",
    "credit_card": "critical", "bank_account": "critical", "biometric": "critical", "health": "critical",
    "email": "high", "phone": "high", "address": "high", "name": "high",
    "first_name": "high", "last_name": "high", "date_of_birth": "high",
    "ip_address": "medium", "device_id": "medium", "location": "medium", "age": "medium",
    "gender": "low",
}

MASKED_NAME_PARTS = [
    "_hash", "_hashed", "_masked", "_encrypted", "_redacted", "_anonymized", "_tokenized", "_obfuscated",
    "hash_", "masked_", "encrypted_",
]
#: on nodes of a trace only the suffix forms count
MASKED_SUFFIX_PARTS = MASKED_NAME_PARTS[:8]
MASKED_FLAGS = ["masked", "hashed", "encrypted"]
MASKED_TRANSFORMATIONS = ["hash", "mask", "encrypt", "redact"]

NAME_PREFIXES = ["stg_", "staging_", "int_", "intermediate_", "dim_", "fct_", "rpt_", "raw_"]

TIMESTAMP_PARTS = [
    "_at", "_date", "_time", "_ts", "timestamp", "created", "updated", "modified", "deleted", "_dts", "_datetime",
]
METRIC_PARTS = [
    "amount", "total", "sum", "count", "avg", "average", "quantity", "qty", "price", "cost", "revenue", "profit",
    "_amt", "_cnt", "_sum",
]

TASK_TYPES: dict[str, list[str]] = {
    "python": ["python"],
    "bash": ["bash"],
    "sql": ["sql", "postgres", "mysql", "snowflake", "bigquery"],
    "dbt": ["dbt"],
    "spark": ["spark"],
    "sensor": ["sensor"],
    "trigger": ["trigger"],
}

OPERATION_TYPES: dict[str, list[str]] = {
    "extract": ["extract", "fetch", "get", "read", "pull"],
    "load": ["load", "write", "insert", "upload", "push"],
    "transform": ["transform", "process", "compute", "calculate", "dbt"],
    "validate": ["validate", "check", "test", "quality"],
    "aggregate": ["aggregate", "sum", "count", "group"],
    "join": ["join", "merge"],
    "filter": ["filter", "where"],
}

TABLE_TYPES: dict[str, str] = {
    "BASE TABLE": "table", "VIEW": "view", "MATERIALIZED VIEW": "materialized_view", "EXTERNAL TABLE": "external_table",
}

WAREHOUSE_TAG_TYPES: dict[str, tuple[str, str | None, bool]] = {
    # tag: (semantic type, pii type, infer the pii type from the column name)
    "PII": ("pii", None, True),
    "PII:EMAIL": ("pii", "email", False),
    "PII:PHONE": ("pii", "phone", False),
    "PII:SSN": ("pii", "ssn", False),
    "PII:ADDRESS": ("pii", "address", False),
    "PII:NAME": ("pii", "name", False),
    "PII:CREDIT_CARD": ("pii", "credit_card", False),
    "PII:IP_ADDRESS": ("pii", "ip_address", False),
    "SENSITIVE": ("pii", "confidential", False),
    "PRIMARY_KEY": ("business_key", None, False),
    "FOREIGN_KEY": ("foreign_key", None, False),
}

KEY_ENDINGS = ["_id", "_key"]
PRIMARY_KEY_NAMES = ["id", "pk", "primary_key"]
SURROGATE_PARTS = ["_sk", "surrogate"]
BUSINESS_PARTS = ["natural", "business", "_bk"]

FLOAT_TYPES = ["FLOAT", "DOUBLE", "REAL"]
TEXT_TYPES = ["TEXT", "STRING"]
KEPT_TYPES = ["DATE", "TIME", "ARRAY", "BOOLEAN"]
BINARY_TYPES = ["BINARY", "VARBINARY"]

CAST_CALLS = ["cast", "try_cast"]
AGGREGATE_CALLS = ["sum", "avg", "count", "min", "max"]
STRING_CALLS = ["concat", "substring", "substr", "upper", "lower"]
DATE_CALLS = ["date_add", "dateadd", "date_sub", "datesub", "datediff", "date_diff", "extract", "date_trunc", "datetrunc"]

EXPRESSION_CONFIDENCE: dict[str, float] = {
    "identity": 1.0, "cast": 0.95, "aggregate": 0.95, "string_transform": 0.9, "arithmetic": 0.9,
    "date_transform": 0.9, "conditional": 0.85, "subquery": 0.7, "formula": 0.8,
}
STATEMENT_FACTOR: dict[str, float] = {"select": 1.0, "insert": 0.95, "update": 0.9}

DEPENDENCY_TYPES: dict[str, str] = {
    "consumes": "read", "produces": "write", "validates": "read", "transforms": "transform",
}

# ---------------------------------------------------------------------------
# Helpers
# ---------------------------------------------------------------------------


def literal_map(values: Mapping[str, object]) -> Column:
    """A map literal of a fixed table."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: Mapping[str, object], key: Column, default: object = None) -> Column:
    found = F.try_element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def present(c: Column) -> Column:
    """True where a text value is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """True where ``c`` contains one of the literal ``parts``."""
    found = c.contains(parts[0])
    for part in parts[1:]:
        found = found | c.contains(part)
    return found


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first true condition."""
    chain = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def any_pattern(c: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any of the patterns."""
    return c.rlike("(?i)" + "|".join(patterns))


def _meta(meta: Column | None, key: str) -> Column:
    return F.lit(None).cast("string") if meta is None else F.try_element_at(meta, F.lit(key))


def _truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(c).isin("", "false", "0", "none", "null", "[]", "{}"), F.lit(False))


# ---------------------------------------------------------------------------
# Names
# ---------------------------------------------------------------------------


def normalize_name(name: Column) -> Column:
    """Lower case, first matching layer prefix stripped, ``_`` and ``-`` dropped."""
    stripped = F.regexp_replace(F.lower(name), "^(?:" + "|".join(NAME_PREFIXES) + ")", "")
    return F.trim(F.translate(stripped, "_-", ""))


def table_urn(prefix: str, kind: Column, namespace: Column, name: Column) -> Column:
    """``{prefix}:{kind}:{namespace}:{name}``"""
    return F.concat_ws(":", F.lit(prefix), kind, namespace, name)


def safe_id(urn: Column) -> Column:
    """An identifier without ``:``, ``.`` and ``-``."""
    return F.translate(urn, ":.-", "___")


# ---------------------------------------------------------------------------
# Columns
# ---------------------------------------------------------------------------


def pii_type_of_name(name: Column, patterns: Mapping[str, Sequence[str]] = PII_NAME_PATTERNS) -> Column:
    return first_match([(any_pattern(name, p), kind) for kind, p in patterns.items()])


def detect_pii(
    name: Column,
    meta: Column | None = None,
    tags: Column | None = None,
    patterns: Mapping[str, Sequence[str]] = PII_NAME_PATTERNS,
) -> Column:
    """struct(pii_type, detected_by): metadata first, then tags, then the name."""
    flag = _meta(meta, "pii")
    tag_list = F.array().cast("array<string>") if tags is None else F.coalesce(tags, F.array().cast("array<string>"))
    pii_tags = F.filter(F.transform(tag_list, F.lower), lambda t: (t == "pii") | t.startswith("pii:"))
    first_tag = F.get(pii_tags, F.lit(0))
    by_name = pii_type_of_name(name, patterns)
    kind = first_match(
        [
            (F.lower(flag) == "true", F.coalesce(_meta(meta, "pii_type"), F.lit("unknown"))),
            (_truthy(flag), flag),
            (_truthy(_meta(meta, "sensitive")), F.lit("sensitive")),
            (first_tag == "pii", F.lit("unknown")),
            (first_tag.isNotNull(), F.replace(first_tag, F.lit("pii:"), F.lit(""))),
        ],
        by_name,
    )
    tagged = _truthy(flag) | _truthy(_meta(meta, "sensitive")) | first_tag.isNotNull()
    by = F.when(F.coalesce(tagged, F.lit(False)), "tag").when(by_name.isNotNull(), "pattern")
    return F.struct(kind.alias("pii_type"), by.alias("detected_by"))


def infer_pii_type(name: Column) -> Column:
    """PII type from substrings of the name, most specific group first."""
    lowered = F.lower(name)
    return first_match([(contains_any(lowered, p), kind) for kind, p in PII_NAME_SUBSTRINGS.items()])


def pii_severity(pii_type: Column) -> Column:
    return lookup(PII_SEVERITY, F.lower(F.coalesce(pii_type, F.lit(""))), "medium")


def is_masked(name: Column, meta: Column | None = None, transformation: Column | None = None, suffix_only: bool = False) -> Column:
    """Masking shown by the column name, its metadata or the transformation."""
    masked = contains_any(F.lower(name), MASKED_SUFFIX_PARTS if suffix_only else MASKED_NAME_PARTS)
    if meta is not None:
        for flag in MASKED_FLAGS:
            masked = masked | _truthy(_meta(meta, flag))
        masked = masked | F.coalesce(_meta(meta, "transformation").isin(MASKED_TRANSFORMATIONS), F.lit(False))
    if transformation is not None:
        masked = masked | F.coalesce(transformation.isin(MASKED_TRANSFORMATIONS), F.lit(False))
    return masked


def semantic_type(name: Column, pii_type: Column, meta: Column | None = None) -> Column:
    """pii, declared type, key kinds, timestamp, metric; null when nothing fits."""
    n = F.lower(name)
    declared = _meta(meta, "semantic_type")
    ends_like_key = n.endswith(KEY_ENDINGS[0]) | n.endswith(KEY_ENDINGS[1])
    is_pk = n.isin(PRIMARY_KEY_NAMES)
    return first_match(
        [
            (pii_type.isNotNull(), F.lit("pii")),
            (present(declared), declared),
            (ends_like_key & contains_any(n, SURROGATE_PARTS), F.lit("surrogate_key")),
            (ends_like_key & contains_any(n, BUSINESS_PARTS), F.lit("business_key")),
            (ends_like_key & ~is_pk, F.lit("foreign_key")),
            (is_pk | n.endswith("_pk"), F.lit("surrogate_key")),
            (contains_any(n, TIMESTAMP_PARTS), F.lit("timestamp")),
            (contains_any(n, METRIC_PARTS), F.lit("metric")),
        ]
    )


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------


def infer_layer(
    name: Column,
    path: Column | None = None,
    tags: Column | None = None,
    meta: Column | None = None,
    name_patterns: Mapping[str, Sequence[str]] = LAYER_NAME_PATTERNS,
    path_patterns: Mapping[str, Sequence[str]] = LAYER_PATH_PATTERNS,
) -> Column:
    """Declared layer, else the first tag that names a layer, else name and path patterns."""
    declared = F.lower(_meta(meta, "layer"))
    cases = [(present(declared), declared)]
    if tags is not None:
        layers = F.transform(tags, lambda t: lookup(LAYER_TAGS, F.lower(t)))
        tagged = F.get(F.filter(layers, lambda layer: layer.isNotNull()), F.lit(0))
        cases.append((tagged.isNotNull(), tagged))
    for layer, patterns in name_patterns.items():
        fits = any_pattern(name, patterns)
        if path is not None:
            fits = fits | F.coalesce(any_pattern(path, path_patterns[layer]), F.lit(False))
        cases.append((fits, F.lit(layer)))
    return first_match(cases)


def layer_of_schema(schema_name: Column, patterns: Mapping[str, Sequence[str]] = SCHEMA_LAYER_PATTERNS) -> Column:
    """Layer from a warehouse schema name; patterns are anchored at the start."""
    return first_match([(schema_name.rlike("(?i)^(?:" + "|".join(p) + ")"), layer) for layer, p in patterns.items()])


def domain_of_path(path: Column) -> Column:
    """Deepest folder of a file path that can be a domain name."""
    parts = F.split(path, "/")
    folders = F.transform(F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))), F.lower)
    fits = F.filter(
        folders,
        lambda f: ~f.isin(NON_DOMAIN_FOLDERS) & ~f.startswith("_") & (f.rlike(r"^\p{L}+$") | f.contains("_")),
    )
    return F.get(fits, F.lit(0))


def infer_domain(path: Column, tags: Column | None = None, meta: Column | None = None) -> Column:
    """Declared domain, else the first ``domain:`` tag, else the folder."""
    declared = F.lower(_meta(meta, "domain"))
    cases = [(present(declared), declared)]
    if tags is not None:
        tag = F.get(F.filter(F.transform(tags, F.lower), lambda t: t.startswith("domain:")), F.lit(0))
        cases.append((tag.isNotNull(), F.replace(tag, F.lit("domain:"), F.lit(""))))
    return first_match(cases, F.when(present(path), domain_of_path(path)))


def domain_of_tags(tags: Column, prefix: str = "domain:") -> Column:
    """First non-empty remainder of a tag that starts with ``prefix``."""
    rest = F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.trim(F.substr(t, F.lit(len(prefix) + 1))))
    return F.get(F.filter(rest, lambda r: r != ""), F.lit(0))


def table_kind(table_type: Column) -> Column:
    return lookup(TABLE_TYPES, F.upper(table_type), "table")


def standard_type(data_type: Column) -> Column:
    """Warehouse data type names to standard ones; others pass unchanged."""
    t = F.upper(data_type)
    return first_match(
        [
            (t.contains("NUMBER") & t.contains(",0)"), F.lit("INTEGER")),
            (t.contains("NUMBER"), F.lit("DECIMAL")),
            (t.isin(FLOAT_TYPES), F.lit("FLOAT")),
            (t.startswith("VARCHAR") | t.isin(TEXT_TYPES), F.lit("STRING")),
            (t.contains("TIMESTAMP") & t.contains("LTZ"), F.lit("TIMESTAMP_TZ")),
            (t.contains("TIMESTAMP"), F.lit("TIMESTAMP")),
            (t.isin(KEPT_TYPES), t),
            (t == "VARIANT", F.lit("JSON")),
            (t == "OBJECT", F.lit("STRUCT")),
            (t.isin(BINARY_TYPES), F.lit("BINARY")),
        ],
        data_type,
    )


# ---------------------------------------------------------------------------
# Tasks and expressions
# ---------------------------------------------------------------------------


def task_type(operator: Column) -> Column:
    o = F.lower(operator)
    return first_match([(contains_any(o, parts), kind) for kind, parts in TASK_TYPES.items()], "custom")


def operation_type(operator: Column, task_id: Column) -> Column:
    text = F.concat_ws(" ", F.lower(operator), F.lower(task_id))
    return first_match([(contains_any(text, parts), kind) for kind, parts in OPERATION_TYPES.items()], "unknown")


def duration_seconds(days: Column, seconds: Column) -> Column:
    return F.coalesce(days, F.lit(0)) * 86400 + F.coalesce(seconds, F.lit(0))


def dependency_type(edge_type: Column) -> Column:
    return lookup(DEPENDENCY_TYPES, edge_type, "read")


def _outside_brackets(text: Column) -> Column:
    """The text at bracket depth 0, at any nesting; a closing bracket without an opening one stays.

    One pass over the characters with two numbers gives the greatest depth, and as many passes drop the innermost
    pairs; what an opening bracket without a closing one leaves open is dropped to the end.
    """

    def step(state: Column, ch: Column) -> Column:
        now = F.greatest(state["now"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(F.split(text, ""), zero, step, lambda s: s["most"])
    closed = F.aggregate(F.sequence(F.lit(1), depth), text, lambda s, _: F.regexp_replace(s, r"\([^()]*\)", ""))
    return F.when(text.contains("("), F.substring_index(closed, "(", 1)).otherwise(text)


def transformation_of(expression: Column, statement: Column | None = None) -> Column:
    """struct(transformation_type, transformation_logic, confidence) of a SQL expression text.

    Works on the text of one select item: quoted strings and bracketed parts
    are blanked to see whether an operator stands at the top level.
    """
    e = F.trim(expression)
    low = F.lower(e)
    flat = _outside_brackets(F.regexp_replace(low, "'[^']*'", "s"))
    call = lambda names: low.rlike(r"^(?:" + "|".join(names) + r")\s*\(")
    kind = first_match(
        [
            (low.rlike(r'^[\w"`]+(?:\.[\w"`]+)*$') & ~low.rlike(r"^[0-9]"), "identity"),
            (low.rlike(r"^case\b") & low.rlike(r"\bend$"), "conditional"),
            (low.rlike(r"^\(\s*select\b"), "subquery"),
            (flat.rlike(r"[\w)\s][-+*/][\w\s(]"), "arithmetic"),
            (call(CAST_CALLS) | flat.rlike(r"::\s*\w+$"), "cast"),
            (call(AGGREGATE_CALLS), "aggregate"),
            (call(STRING_CALLS), "string_transform"),
            (call(DATE_CALLS), "date_transform"),
        ],
        "formula",
    )
    confidence = lookup(EXPRESSION_CONFIDENCE, kind)
    if statement is not None:
        confidence = confidence * lookup(STATEMENT_FACTOR, F.lower(statement), 1.0)
    return F.named_struct(
        F.lit("transformation_type"), kind,
        F.lit("transformation_logic"), F.when(kind != "identity", e),
        F.lit("confidence"), confidence,
    )


def tag_types(tag_name: Column, tag_value: Column, custom: Mapping[str, tuple[str, str | None, bool]] | None = None) -> Column:
    """struct(semantic_type, pii_type, infer) of a warehouse tag; custom mapping first, any case."""
    tag = F.upper(F.when(present(tag_value), F.concat_ws(":", tag_name, tag_value)).otherwise(tag_name))
    tables = [t for t in ({k.upper(): v for k, v in (custom or {}).items()}, WAREHOUSE_TAG_TYPES) if t]
    semantic = F.coalesce(*[lookup({k: v[0] for k, v in t.items()}, tag) for t in tables])
    source = F.coalesce(*[F.when(F.array_contains(F.array(*[F.lit(k) for k in t]), tag), F.lit(i)) for i, t in enumerate(tables)])
    pii = infer = F.lit(None)
    for i, t in reversed(list(enumerate(tables))):
        typed = {k: v[1] for k, v in t.items() if v[1] is not None}
        kind = lookup(typed, tag) if typed else F.lit(None).cast("string")
        pii = F.when(source == i, kind).otherwise(pii)
        infer = F.when(source == i, lookup({k: v[2] for k, v in t.items()}, tag)).otherwise(infer)
    return F.struct(semantic.alias("semantic_type"), pii.cast("string").alias("pii_type"), F.coalesce(infer.cast("boolean"), F.lit(False)).alias("infer"))
