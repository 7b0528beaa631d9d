"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Each query
runs twice; ``queries`` holds the second run, ``cold`` the first one, which includes compiling and,
for the first query that needs it, building the word index or the triple table. BENCH_QUERIES
(comma separated) picks other queries, ``all`` takes every registered one.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparkevidence.operators.scale import drop_stored
from sparkevidence.plans import catalog

HEADLINE = (
    "bm25_index_stats", "bm25_topk", "dense_topk", "dense_all_pairs", "rrf_hybrid",
    "multi_query_merge", "entity_boost", "diversify", "dedupe_first", "sentence_filter",
    "extractive_compress", "pack_context", "gene_summary", "gene_correlation",
    "codependency_topk", "validate_pairs", "kb_documents", "negatives_random", "kg_node_info",
    "kg_subgraph_1hop", "kg_subgraph_2hop", "build_graph", "graph_expand", "graph_relevance",
    "page_links", "page_text", "resolve_records", "trial_fields", "accuracy_by_task",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sparkevidence-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(HEADLINE)
    if chosen:
        names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",")
    spark = session()
    cold, warm = {}, {}
    for name in names:
        cold[name] = timed(spark, name, sf_dir)
        warm[name] = timed(spark, name, sf_dir)
    drop_stored(spark)
    spark.stop()
    print(
        json.dumps({
            "metric": "total_warm_seconds",
            "value": round(sum(warm.values()), 3),
            "unit": "sec",
            "queries": warm,
            "cold": cold,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        })
    )


if __name__ == "__main__":
    main()
