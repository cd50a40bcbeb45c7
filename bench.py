"""Headline queries at one scale, and the rate of three jobs at all scales; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callwarden.queries.registry import registered  # noqa: E402
from callwarden.session import local_session  # noqa: E402

HEADLINE = [
    "review_mix", "classify", "funnel", "leak_report", "declaration_shapes", "api_usage",
    "scrub_documents", "value_shapes_documents", "guard_documents", "bayes_languages",
    "crc_thresholds", "hook_log_import",
]
#: Query and table whose rows are counted: classification, event summary, naive-Bayes training.
JOBS = {"classify": "events", "insights": "events", "bayes_weights": "documents"}
SCALES = ["sf0.001", "sf0.01", "sf0.1"]
#: A query that takes longer than this runs once; the others count as the median of three.
ONCE_S = 5.0


def seconds(spark, sf: str, name: str) -> float:
    start = time.time()
    registered()[name][0](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    chosen = sys.argv[1:] or HEADLINE
    home = os.path.dirname(sf)
    if os.path.isdir(f"{home}/sf0.001"):  # compiles code and starts workers
        for name in ("classify", "guard_documents", "crc_thresholds"):
            seconds(spark, f"{home}/sf0.001", name)
    times: dict[str, float] = {}
    for name in chosen:
        took = [seconds(spark, sf, name)]
        if took[0] <= ONCE_S:
            took += [seconds(spark, sf, name) for _ in range(2)]
        times[name] = round(statistics.median(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rates: dict[str, dict[str, float]] = {}
    for job, table in JOBS.items() if not sys.argv[1:] else ():
        rates[job] = {}
        for scale in SCALES:
            where = f"{home}/{scale}"
            if os.path.isdir(where):
                known = times.get(job) if where == sf else None
                rows = spark.read.parquet(f"{where}/{table}.parquet").count()
                rates[job][scale] = round(rows / (known or seconds(spark, where, job)), 1)
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf),
        "rows_per_second": rates,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
