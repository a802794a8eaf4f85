"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from ewpanel.plans import QUERIES

USED = {"region", "nation", "customer", "orders", "lineitem", "part", "supplier", "events", "embeddings"}
HEADLINE = [
    "panel_escalation", "coded_panel", "coded_escalation", "price_two_level", "asof_prior_month", "nearest_event", "candidate_age_windows",
    "candidate_forward_labels", "candidate_rings", "hawkes_intensity", "cusum", "grid_diffusion", "average_precision_and_auc", "threshold_curve",
    "frozen_threshold_validation", "expanding_folds", "actor_pair_stats", "hypergraph_propagation", "theme_ppmi", "analog_rates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["global_summary"](spark, sf).collect()  # the session's first query loads classes
    rows = {p.removesuffix(".parquet"): spark.read.parquet(f"{sf}/{p}").count() for p in sorted(os.listdir(sf)) if p.removesuffix(".parquet") in USED}
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "input_rows": rows, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
