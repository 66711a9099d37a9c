"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
    BENCH_EVENTLOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py   # + stage/task times

Each query runs to completion through a ``noop`` write (the whole plan
executes, nothing is collected).  A warm-up pass at sf0.001 first takes
JVM start-up and code generation out of the timings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepanel.plans.catalog import all_queries  # noqa: E402
from tidepanel.session import local_session, prepare  # noqa: E402

HEADLINE = ["gold_panel", "features", "clean_drivers", "gram_matrix", "rolling_backtest",
            "arma_fit"]
WARM_DIR = "/root/testdata/sf0.001"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="tidepanel-bench",
                          event_log_dir=os.environ.get("BENCH_EVENTLOG_DIR"))
    prepare(spark)
    qs = all_queries()
    for n in names:
        run(qs[n].build(spark, WARM_DIR))
    times = {}
    for n in names:
        t0 = time.perf_counter()
        run(qs[n].build(spark, sf_dir))
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
