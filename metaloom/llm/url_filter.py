"""Rule lists for URLs: host suffixes and path prefixes, joined by short hash prefixes.

Each distinct URL is expanded into the expressions (host suffix, path prefix) that a rule of the list could have;
expressions and rules meet in an equi-join on the first 32 bits of a SHA-256 digest, and the whole digest confirms.
The expansion is bounded by the list: only suffixes of as many labels, and prefixes of as many characters, as some
rule has. Of the rules that fit, the longest wins (host and path together; among equals block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: up to so many rules (about 200 bytes each) are sent to every executor; more are joined by a shuffle
BROADCAST_RULES = 50_000
#: hexadecimal digits of the digest that are joined on
SHORT = 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Distinct ``url`` -> host, path, rule, verdict.

    ``rules``: host, path, verdict (``allow`` or ``block``). A null or malformed URL has an empty host and path,
    fits no rule and gets ``default``. Repeated rules count once. Without rules all get ``default``.
    """
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    listed = listed.select(
        F.concat("host", "path").alias("rule"), "verdict", _digest(F.col("host"), F.col("path")).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"),
    )
    n, labels, chars = listed.agg(F.count(F.lit(1)), F.collect_set("labels"), F.collect_set("chars")).first()
    parts = urls.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not n:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))

    some = F.array(*(F.lit(x) for x in sorted(labels)))
    widths = F.array(*(F.lit(x) for x in sorted(chars)))
    expanded = (
        parts.where(F.col("host") != "")
        .withColumn("_n", F.explode(F.filter(some, lambda k: k <= F.size(F.split("host", r"\.")))))
        .withColumn("_w", F.explode(F.filter(widths, lambda k: k <= F.length("path"))))
        .select("url", _digest(F.expr("substring_index(host, '.', -_n)"), F.expr("substring(path, 1, _w)")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    keyed = listed.withColumn("short", F.substring("digest", 1, SHORT)).withColumnRenamed("digest", "full")
    met = expanded.join(F.broadcast(keyed) if n <= BROADCAST_RULES else keyed, "short").where(F.col("digest") == F.col("full"))
    best = met.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("_best"))
    return parts.join(best, "url", "left").select(
        "url", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; rows with a null URL included, repeated rows kept."""
    judged = judge(pages.where(F.col("url").isNotNull()), rules, default)
    known = pages.select("page_id", "url").join(judged, "url", "left")
    return known.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
