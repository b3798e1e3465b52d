"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1; more give the
median), BENCH_KEYS (comma-separated).  The session is warmed up with one query; progress goes to stderr.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from verification.compare import make_session
from verification.queries import QUERIES

HEADLINE = (
    "expand_house_info", "finalize", "dedup_first", "iqr_filter", "etl_clean", "district_price_rank",
    "price_histogram", "community_followers", "quality_report", "search_topk",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = make_session(int(os.environ.get("BENCH_CPUS", "8")))

    def timed(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    timed("floor_band")
    for key in os.environ.get("BENCH_KEYS", ",".join(HEADLINE)).split(","):
        seconds[key] = round(statistics.median(timed(key) for _ in range(runs)), 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
