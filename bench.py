"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default: all).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from colloquy.plans import catalog

HEADLINE = [
    "visible_messages",
    "collapse_retries",
    "merge_messages",
    "active_path",
    "segments",
    "pending_tail",
    "manifest",
    "rolling_context",
    "statements",
    "fragments",
    "near_dup_pairs",
    "dominant_ngram",
    "validate_statements",
    "fenced_blocks",
    "archive_blocks",
    "working_view",
    "topic_boundaries",
    "similarity_report",
    "topk",
    "embed",
    "retrieve",
    "hydrate",
    "answer",
    "segment_summary",
    "insert_ignore",
    "delete_extracts",
    "count_all",
    "lineage",
    "job_state",
    "stream_segments",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
