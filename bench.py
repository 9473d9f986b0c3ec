"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm the JVM and once timed, with all rows computed and no result collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rosterkit.queries import registry  # noqa: E402
from rosterkit.session import get_session  # noqa: E402

HEADLINE = [
    "extract_roster", "extract_standard", "explode_names", "explode_pairs", "detect_header", "header_report",
    "compile_roster", "compile_parts", "parted_output", "compile_diagnosis", "run_outcome", "admit_runs",
    "validate_requests", "alias_defaults", "alias_residual", "merge_aliases", "similar_words", "clean_name", "match_key",
    "parse_date", "scan_delimited", "scan_quoted_text", "scan_workbook", "dedup_rows", "file_log", "output_index",
    "incremental_reports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "rosterkit-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    timings = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
