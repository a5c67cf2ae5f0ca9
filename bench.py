"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metaloom.plans.catalog import QUERIES, Catalog  # noqa: E402

HEADLINE = [
    "g2_downstream", "g4_downstream_columns", "g15_pii_trace", "pii2_exposure_breakdown", "cf7_score", "agg13_capsule_catalog",
    "flt4_search", "sim4_metadata_score", "imp4_imp5_overall_risk", "tmp2_quiet_windows", "slo_products", "pr1_counts", "pr2_quantiles",
    "dq1_row_rules", "dq5_uniqueness", "msk5_apply_rules", "snk1_upsert", "ver1_schema_changes", "piit_documents", "sla1_breaches",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("metaloom-bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = Catalog(spark, root)
    catalog.table("orders").count()  # start the executor before timing
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](catalog).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
