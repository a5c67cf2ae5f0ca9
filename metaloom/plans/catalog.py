"""All registered queries; importing this module fills the registry."""

from metaloom.plans import (  # noqa: F401
    conformance_queries,
    export_queries,
    filter_queries,
    impact_queries,
    lineage_queries,
    model_queries,
    pii_queries,
    quality_queries,
    rollup_queries,
    similarity_queries,
    snapshot_queries,
    source_queries,
)
from metaloom.plans.registry import ORACLES, QUERIES, Catalog

__all__ = ["QUERIES", "ORACLES", "Catalog"]
