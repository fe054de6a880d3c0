"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from corvidex.plans import QUERIES
from corvidex.session import session

HEADLINE = ("bm25_documents", "event_cochange", "blast_radius", "ledger_rollup", "endpoint_join", "vector_topk", "hybrid_additive", "facts_at", "asof_join", "sessionize_gap", "redact_secrets", "daily_digest", "label_propagation", "exact_dup_groups", "community_quotient")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["kind_counts"](spark, sf_dir).collect()  # the session's start isn't a query's time
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
