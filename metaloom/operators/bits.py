"""Sets of numbers as rows (block, bits): neighbouring numbers share a row, and rows meet by ``bit_or``, which is combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: hubs or seeds of one row: what a long holds without its last bits, which would overflow in sums
WIDTH = 60


def block(number: str) -> Column:
    return F.expr(f"{number} DIV {WIDTH}")


def bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({number} % {WIDTH} AS INT))")


def positions(bits: str) -> Column:
    """The places of the set bits; a single one, the most frequent case, needs no loop."""
    return F.expr(f"CASE WHEN bit_count({bits}) = 1 THEN array(bit_count({bits} - 1)) ELSE filter(sequence(0, {WIDTH - 1}), i -> getbit({bits}, i) = 1) END")


def numbers(block: str, bits: str, name: str) -> Column:
    """A row for each set bit."""
    return F.explode(F.transform(positions(bits), lambda i: F.col(block) * WIDTH + i)).alias(name)


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def by_block(numbered: DataFrame) -> DataFrame:
    """(block, names): what the bits of a block stand for, an array by their places; ``numbered`` (name, at)."""
    named = numbered.groupBy(block("at").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % WIDTH).cast("int"), "name"))).alias("_m"))
    return named.select("block", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.col("_m")[i]).alias("names"))


def named(bits: str, names: str, name: str) -> Column:
    """A row for each set bit, by its name of ``by_block``."""
    return F.explode(F.transform(positions(bits), lambda i: F.get(names, i))).alias(name)
