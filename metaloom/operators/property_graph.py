"""The catalog as one property graph: node and edge tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTIES = "map<string,string>"


def _nodes(df: DataFrame, urn: Column, name: Column, kind: Column, layer: Column | None = None, domain: Column | None = None, **properties: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    pairs = [x for k, v in properties.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast(PROPERTIES)
    return df.select(
        urn.alias("urn"), name.alias("name"), kind.alias("node_type"), (none if layer is None else layer).alias("layer"),
        (none if domain is None else domain).alias("domain"), values.alias("properties"),
    )


def _edges(df: DataFrame, source: Column, target: Column, kind: Column) -> DataFrame:
    return df.select(source.alias("source_urn"), target.alias("target_urn"), kind.alias("edge_type"))


def build(tables: Mapping[str, DataFrame], prefix: str = "urn:cat") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every catalog table given.

    Understands capsules, domains, edges, columns, column_edges, tags,
    capsule_tags, products and product_members; each is one projection.
    """
    c = F.col
    urn_of = lambda kind, name: F.concat(F.lit(f"{prefix}:{kind}:"), name)
    nodes, edges = [], []
    if "domains" in tables:
        nodes.append(_nodes(tables["domains"], urn_of("domain", c("domain")), c("domain"), F.lit("domain")))
    if "capsules" in tables:
        t = tables["capsules"]
        nodes.append(_nodes(t, c("urn"), c("name"), c("capsule_type"), c("layer"), c("domain"), **({"has_pii": c("has_pii")} if "has_pii" in t.columns else {})))
        edges.append(_edges(t.filter(c("domain").isNotNull()), c("urn"), urn_of("domain", c("domain")), F.lit("BELONGS_TO")))
    if "edges" in tables:
        edges.append(_edges(tables["edges"], c("source_urn"), c("target_urn"), F.upper("edge_type")))
    if "columns" in tables:
        t = tables["columns"]
        nodes.append(_nodes(t, c("urn"), c("name"), F.lit("column"), **{k: c(k) for k in ("data_type", "semantic_type", "pii_type") if k in t.columns}))
        edges.append(_edges(t, c("capsule_urn"), c("urn"), F.lit("CONTAINS")))
    if "column_edges" in tables:
        edges.append(_edges(tables["column_edges"], c("source_column_urn"), c("target_column_urn"), F.lit("DERIVED_FROM")))
    if "tags" in tables:
        nodes.append(_nodes(tables["tags"], urn_of("tag", c("tag")), c("tag"), F.lit("tag"), category=c("category"), sensitivity_level=c("sensitivity_level")))
    if "capsule_tags" in tables:
        edges.append(_edges(tables["capsule_tags"], c("capsule_urn"), urn_of("tag", c("tag")), F.lit("TAGGED_WITH")))
    if "products" in tables:
        nodes.append(_nodes(tables["products"], urn_of("product", c("product")), c("product"), F.lit("data_product"), None, c("domain"), status=c("status")))
    if "product_members" in tables:
        edges.append(_edges(tables["product_members"], c("capsule_urn"), urn_of("product", c("product")), F.lit("PART_OF")))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def first_of_each(nodes: DataFrame) -> DataFrame:
    """One node per URN; of several the smallest type decides."""
    row = F.struct("node_type", "name", "layer", "domain", F.to_json("properties").alias("_p"))
    chosen = nodes.groupBy("urn").agg(F.min(row).alias("r"))
    return chosen.select("urn", "r.name", "r.node_type", "r.layer", "r.domain", F.from_json("r._p", PROPERTIES).alias("properties"))
