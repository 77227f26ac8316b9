"""Benchmark: headline queries of every operator group, written to a no-op sink.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Prints one JSON line. ``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import time

from statloom.plans import load_all
from statloom.plans.registry import QUERIES
from statloom.session import local_session

HEADLINE = (
    "P01_tables_and_lists", "P02_category_report", "S03_api_items", "S05_nested_numbers", "U06_source_analysis",
    "N15_year_from_text", "N17_year_cascade", "N25_page_text", "C04_topic", "Q03_national_context", "Q13_page_richness",
    "F07_strict_validation", "F11_permissive_recovery", "F18_validation_fallback", "X01_adjacent_pairs",
    "X02_header_tables", "X06_text_patterns", "X11_generic_patterns", "X19_text_pairs", "L05_keyword_fallback",
    "J03_upsert_tasks", "J07_first_available", "J09_crawl", "A05_task_metrics", "A06_combined_analyses",
    "A09_target_coverage", "A16_endpoint_statistics", "W01_cap_per_group", "W03_running_means", "W06_progress_tracking",
    "O01_newest_tasks", "M06_apply_fixes", "T02_task_progress",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus, "bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("statloom.text.tasks", str(spark.sparkContext.defaultParallelism))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    # Start the JVM, the code generator and the parquet reader once, outside the measurement.
    QUERIES["A14_task_counts"].frame(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].frame(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
