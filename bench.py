"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from snipdex.plans import all_queries  # noqa: E402
from snipdex.session import build_session  # noqa: E402

HEADLINE = [
    "knn_exact", "knn_blocks", "knn_lsh", "centroid_search", "text_search",
    "token_estimate", "truncate_lines", "chunk_overlap", "embedded_blocks",
    "extract_code", "index_build", "incremental_rebuild", "snapshot_diff", "replace_by_file",
    "registry_stats", "library_list", "json_predicates", "config_audit", "config_clean", "membership_update",
    "nearest_ancestor", "glob_filter", "detect_type", "structure_advice",
    "task_summary", "work_queue", "status_transition_audit",
    "debounce_batch", "debounce_stream", "batch_assign",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = all_queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        table[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        "documents_per_sec": {n: round(documents / seconds[n]) for n in ("token_estimate", "truncate_lines", "extract_code", "index_build", "text_search") if n in seconds},
        "events_per_sec": {n: round(events / seconds[n]) for n in ("debounce_batch", "debounce_stream") if n in seconds},
    }
    total = round(sum(seconds.values()), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf, "cpus": int(cpus), "runs": runs, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
