"""Registry of the runnable queries and their oracle statements."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from metaloom import staging
from metaloom.plans import views as catalog_views


@dataclass(frozen=True)
class Catalog:
    """Where a query reads: the given parquet tables and the views over them."""

    spark: SparkSession
    root: str

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """One analysed DataFrame per application, folder and name (plans only, no data)."""
        key = (self.spark.sparkContext.applicationId, self.root, name)
        if key not in _plans:
            _plans[key] = build()
        return _plans[key]

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.root}/{name}.parquet"))

    def view(self, name: str) -> DataFrame:
        """A catalog view. Views that group or join the large tables are written once for an application, all others are inlined."""
        if name not in catalog_views.WRITTEN:
            return self._once(name, lambda: self._define(name))
        return self._once(f"{name}#{staging.generation()}", lambda: staging.stage(self._define(name), staging.new_stage(self.spark, name)))

    def _define(self, name: str) -> DataFrame:
        bodies = catalog_views.bodies(name)
        written = [n for n, body in bodies.items() if body is None]
        text = "\n".join(b for b in bodies.values() if b)
        given = {t: self.table(t) for t in catalog_views.BASE_TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)} | {n: self.view(n) for n in written}
        parts = []
        for relation, df in given.items():
            view = f"ml_{zlib.crc32(self.root.encode()):08x}_{relation}"
            df.createOrReplaceTempView(view)
            parts.append(f"{relation} AS (SELECT * FROM {view})")
        parts += [f"{n} AS ({body})" for n, body in bodies.items() if body]
        return self.spark.sql(f"WITH {', '.join(parts)}\nSELECT * FROM {name}")


_plans: dict[tuple[str, str, str], DataFrame] = {}
Query = Callable[[Catalog], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; views the oracle mentions are defined for it in a WITH clause.

    An oracle may begin with its own common table expressions, written as
    ``WITH a AS (...)``; they are appended after the views.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return add


def oracle_text(sql: str) -> str:
    body = sql.strip()
    own = ""
    if body.upper().startswith("WITH "):
        own, body = body[5:], ""
    defined = catalog_views.with_clause(*catalog_views.views_in(sql)) if catalog_views.views_in(sql) else ""
    if own:
        return f"WITH RECURSIVE {defined}{',' if defined else ''}\n{own}"
    return f"WITH RECURSIVE {defined}\n{body}" if defined else body
