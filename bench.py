"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores.  Each query is timed from building its plan to its last row (noop sink),
deriving its text view from the tables included.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmill.catalog.queries import QUERIES  # noqa: E402
from corpusmill.session import DEFAULTS  # noqa: E402

HEADLINE = [
    "language_histogram",
    "ignored_dir_filter",
    "ignore_patterns",
    "tree_listing",
    "directory_budget",
    "reference_count",
    "file_stats",
    "retention",
    "chunks",
    "duplicate_sections",
    "comment_collapse",
    "truncate_middle",
    "symbols",
    "import_summary",
    "html_list_trim",
    "generic_reduce_heavy",
    "rule_effects",
    "report_assembly",
    "corpus_reduce",
    "corpus_reduce_heavy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["language_tag"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
