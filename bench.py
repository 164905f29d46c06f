"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs end-to-end from the raw parquet tables and is forced with
the ``noop`` sink (full execution, nothing collected to the driver).  One
warm-up pass, then the median of three timed runs per query.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiftscope.plans.catalog import load_all  # noqa: E402
from shiftscope.session import build_session  # noqa: E402

HEADLINE = [
    "job_stats", "pay_metrics", "top_benefits", "dedup_first", "best_record", "posting_state",
    "no_shift_rates", "schedule_mentions", "monthly_pay", "legacy_row", "rate_cascade",
    "shift_len", "rate_mentions", "working_hours", "page_links", "strip_html", "script_lang",
    "detail_fields", "event_state_batch",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    # warm-up (JIT, codegen cache, Python workers) on the smaller scale factor
    # when it sits next to the timed one: same plans, a fraction of the time
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for n in names:
        run(reg[n].build(spark, warm_dir))
    times = {}
    for n in names:
        ts = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(reg[n].build(spark, sf_dir))
            ts.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(ts), 3)
    sf_txt = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_txt)
    except ValueError:
        sf = sf_txt
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()
