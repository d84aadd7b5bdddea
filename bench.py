"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs its whole plan into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelake import catalog  # noqa: E402
from pagelake.session import build_session  # noqa: E402

HEADLINE = [
    "estimate_savings", "resolve_page_options", "target_size", "compress_report", "merge_documents", "allocate_names",
    "block_stats", "binarize", "page_qa", "pixel_runs", "g4_line_bits", "otsu", "median_profiles", "redact_words",
    "objects_at_points", "batch_summary", "debounced_profile",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf}/region.parquet").count()  # start the executors
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
