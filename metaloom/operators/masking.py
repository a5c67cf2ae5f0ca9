"""Executors for declared masking rules, as native Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.joins import salted_join


def redact(c: Column, replacement: str = "***", preserve_length: bool = False, mask_char: str = "*") -> Column:
    return F.repeat(F.lit(mask_char), F.length(c)) if preserve_length else F.lit(replacement)


def partial_redact(c: Column, show_first: int = 0, show_last: int = 0, mask_char: str = "*") -> Column:
    """Keep the first and last characters; a text too short to hide any is hidden whole."""
    n = F.length(c)
    hidden = n - show_first - show_last
    middle = F.repeat(F.lit(mask_char), F.greatest(hidden, F.lit(0)))
    shown = F.concat(F.substr(c, F.lit(1), F.lit(show_first)), middle, F.when(F.lit(show_last) > 0, F.right(c, F.lit(show_last))).otherwise(""))
    return F.when(hidden > 0, shown).otherwise(F.repeat(F.lit(mask_char), n))


def hashed(c: Column, salt: str = "", bits: int = 256) -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), bits)


def substitute(c: Column, values: Sequence[str], salt: str = "") -> Column:
    """A value of a fixed list, the same for the same input."""
    digit = F.conv(F.substr(hashed(c, salt), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.array(*[F.lit(v) for v in values])[F.pmod(digit, F.lit(len(values))).cast("int")]


def pseudonym(c: Column, prefix: str = "user", salt: str = "") -> Column:
    """A stable made-up name."""
    return F.concat(F.lit(prefix + "_"), F.substr(hashed(c, salt), F.lit(1), F.lit(12)))


def token_table(df: DataFrame, column: str, salt: str = "") -> DataFrame:
    """(value, token): one row per distinct value; keep it apart to reverse the tokens."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.withColumn("token", F.concat(F.lit("tok_"), F.substr(hashed(F.col("value"), salt), F.lit(1), F.lit(32))))


def detokenize(df: DataFrame, column: str, tokens: DataFrame, spread_on: str) -> DataFrame:
    """Replace tokens by their values; a token held by many rows is spread over tasks."""
    by_token = tokens.select(F.col("token").alias(column), F.col("value").alias("_value"))
    joined = salted_join(df, by_token, column, spread_on, how="left")
    return joined.withColumn(column, F.coalesce("_value", column)).drop("_value").select(*df.columns)


def encrypt(c: Column, key: Column, mode: str = "GCM") -> Column:
    """AES, base64 text; ``key`` is 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(c.cast("string"), key, F.lit(mode)))


def decrypt(c: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit(mode)).cast("string")


def generalize(c: Column, bucket_size: float) -> Column:
    """Lower end of the bucket a number falls into."""
    return F.floor(c / bucket_size) * bucket_size


def add_noise(c: Column, key: Column, scale: float, seed: int = 0) -> Column:
    """Add noise in [-scale, scale] that depends only on ``key`` and ``seed``, so retried tasks agree."""
    unit = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2_000_001)) / 1_000_000 - 1
    return c + unit * scale


def mask_characters(c: Column) -> Column:
    """Letters and digits replaced by X, x and n."""
    return F.mask(c)


def masked_value(c: Column, method: str, config: Mapping, preserve_length: bool = False) -> Column:
    """The value a masking method gives."""
    salt = config.get("salt", "")
    if method == "redaction":
        return redact(c, config.get("replacement", "***"), preserve_length, config.get("mask_char", "*"))
    if method == "partial_redaction":
        return partial_redact(c, config.get("show_first", 0), config.get("show_last", 0), config.get("mask_char", "*"))
    if method == "hashing":
        return hashed(c, salt)
    if method == "substitution":
        return substitute(c, config["values"], salt)
    if method == "pseudonymization":
        return pseudonym(c, config.get("prefix", "user"), salt)
    if method == "tokenization":
        return F.concat(F.lit("tok_"), F.substr(hashed(c, salt), F.lit(1), F.lit(32)))
    if method == "encryption":
        return encrypt(c, F.lit(config["key"]), config.get("mode", "GCM"))
    if method == "generalization":
        return generalize(c, config["bucket_size"])
    if method == "noise_addition":
        return add_noise(c, F.col(config["key_column"]), config["scale"], config.get("seed", 0))
    if method == "data_masking":
        return mask_characters(c)
    raise ValueError(f"unsupported masking method {method}")


def apply_rules(df: DataFrame, rules: Sequence[Mapping], role: str | None = None) -> DataFrame:
    """Apply the enabled rules that concern ``role``.

    A rule: column, method, config, condition (SQL over the row), roles,
    exempt_roles, preserve_null (default true), preserve_length,
    preserve_type.  Conditions see the unmasked row.
    """
    changed: dict[str, Column] = {}
    for rule in rules:
        roles, exempt = rule.get("roles") or [], rule.get("exempt_roles") or []
        concerned = not roles or (role not in exempt and role in roles)
        if not rule.get("enabled", True) or not concerned:
            continue
        name = rule["column"]
        original = F.col(name)
        value = masked_value(original, rule["method"], rule.get("config") or {}, rule.get("preserve_length", False))
        if rule.get("preserve_type"):
            value = value.try_cast(df.schema[name].dataType)
        if rule.get("preserve_null", True):
            value = F.when(original.isNotNull(), value)
        if rule.get("condition"):
            value = F.when(F.expr(rule["condition"]), value).otherwise(original)
        changed[name] = value
    return df.withColumns(changed) if changed else df
