"""Benchmark: headline jobs on $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS].

Each job is built from the registered queries and forced in full: row outputs go
to the ``noop`` sink (every row computed, nothing collected), summaries are
collected (a handful of rows). Each job runs three times; the fastest run counts (local runs vary by ±30%).
Prints one JSON line. Set BENCH_EVENT_LOG_DIR to a scratch folder to keep Spark's
event log (stage and task times) of the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskprice.plans.queries import queries  # noqa: E402
from riskprice.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

# (query, how): "rows" -> noop sink, "collect" -> small result collected
HEADLINE = [
    ("price_facilities", "rows"),                 # logistic PD + hybrid LGD, all facilities
    ("price_facilities_score_based_hybrid", "rows"),
    ("portfolio_summary", "collect"),
    ("risk_distribution", "collect"),
    ("recommendation_distribution", "collect"),
    ("model_grid", "collect"),                    # 9 model pairs, one scan
    ("model_grid_distribution", "collect"),
    ("model_grid_rows", "rows"),                  # 9 x facilities priced rows
    ("product_final_price", "rows"),              # all product lines priced
    ("product_summary", "collect"),
    ("valid_facilities", "rows"),
    ("rejected_facilities", "rows"),
    ("priced_facilities_json", "rows"),
]


def run(spark, name, how):
    t0 = time.perf_counter()
    df = queries()[name](spark, SF_DIR)
    if how == "rows":
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()
    return time.perf_counter() - t0


MEMORY = os.environ.get("BENCH_DRIVER_MEMORY", "16g")


def main():
    spark = local_session(cores=str(CPUS), shuffle_partitions=CPUS, app="riskprice-bench",
                          driver_memory=MEMORY,
                          event_log_dir=os.environ.get("BENCH_EVENT_LOG_DIR") or None)
    spark.range(1).count()                       # the JVM is up
    t0 = time.perf_counter()
    queries()["price_facilities"](spark, SF_DIR)
    plan_build = round(time.perf_counter() - t0, 3)     # a cold feed: footers, analysis
    run(spark, "facilities_source", "rows")      # warm-up: file listing, codegen cache
    times = {}
    for name, how in HEADLINE:
        times[name] = round(min(run(spark, name, how) for _ in range(3)), 3)
    from riskprice.sources import tables
    rows = {"facilities": tables.facilities(spark, SF_DIR).count(),
            "product_lines": tables.product_lines(spark, SF_DIR).count()}
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_jobs_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf else SF_DIR,
           "plan_build_sec": plan_build, "cores": CPUS, "driver_memory": MEMORY, "input_rows": rows}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
