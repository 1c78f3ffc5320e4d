"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Every query
runs once to warm up and then once more on the clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "mention_summary", "mention_entities", "extracted_types", "code_entities", "dedupe_entities", "dedupe_relations",
    "infer_relations", "find_related", "dependency_tree", "search_contains", "search_multi_project", "qa_link",
    "type_summary", "diff_entities", "merge_overwrite", "merge_keep_both", "detect_changes", "upsert", "debounce",
    "call_reach_3", "data_flows", "commits", "contributors", "create_relations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first, warm = {}, {}
    for name in HEADLINE:
        first[name] = round(run(name), 3)
        warm[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "first": first, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
