"""Substring search of many patterns in many texts, as an equi-join.

A text that contains a pattern contains each of its q-grams. So every pattern is joined by one of its grams only, the one that
the fewest texts have, and what meets is verified. A pattern with a gram that no text has is out before any text is
touched. Patterns shorter than q are their own gram; the empty one is in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.joins import HOT_ROWS, salted_join
from metaloom.staging import new_stage, stage


def _grams(text: str, width: int) -> Column:
    """Distinct substrings of ``width`` characters; none of a shorter text."""
    if width == 0:
        return F.array(F.lit(""))
    last = F.length(text) - width + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame, q: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(pattern, id): the ids of ``texts`` (id, text) that contain a pattern of ``patterns`` (pattern). Nulls match nothing; case counts."""
    spark = texts.sparkSession
    path = new_stage(spark, "substrings")
    asked = stage(patterns.select("pattern").where("pattern IS NOT NULL").distinct(), f"{path}/patterns")
    held = stage(texts.select("id", "text").where("text IS NOT NULL").distinct(), f"{path}/texts")
    width = F.least(F.length("pattern"), F.lit(q))
    widths = sorted(r[0] for r in asked.select(width).distinct().collect())  # q + 1 numbers at most
    if not widths:
        return asked.join(held.select("id"), F.lit(False)).select("pattern", "id")
    index = stage(held.select("id", F.explode(F.concat(*[_grams("text", w) for w in widths])).alias("gram")), f"{path}/grams")
    spread = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = None
    for w in widths:
        part = asked.where(width == w).select("pattern", F.explode(_grams("pattern", w)).alias("gram"))
        own = part if own is None else own.union(part)
    known = own.join(spread, "gram", "left")
    rarest = known.groupBy("pattern").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g"))).alias("gram"))
    chosen = stage(rarest.where("least > 0").select("pattern", "gram"), f"{path}/rarest")
    met = salted_join(index.join(chosen.select("gram").distinct(), "gram", "left_semi"), chosen, "gram", "id", hot_rows=hot_rows)
    return met.join(held, "id").where(F.col("text").contains(F.col("pattern"))).select("pattern", "id").distinct()
