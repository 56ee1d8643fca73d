"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from convhist.plans import catalogue
from convhist.session import local_session

# The six operations of the reference harness in their Spark form, then the analytical core.
HEADLINE = {
    "scan": "scan_jsonl",
    "rescan": "rescan_changed",
    "list": "list_sessions",
    "search_miss": "search_miss",
    "search_hit": "search_page",
    "export": "bundle_roundtrip",
    "beats": "beats",
    "assistant_evidence": "assistant_evidence",
    "split_text": "split_text",
    "logical_digest": "logical_digest",
    "lineages": "lineages",
    "stratified_order": "stratified_order",
    "pack_batches": "pack_batches",
    "pair_tools": "pair_tools",
    "apply_rollbacks": "apply_rollbacks",
    "map_paths": "map_paths",
    "three_way": "three_way",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, "convhist-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm the JVM
    queries = {}
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[label] = round(time.perf_counter() - start, 3)
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
