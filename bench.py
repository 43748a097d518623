"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is first run once on sf0.01 (JIT and codegen warm-up, not timed),
then timed at ``BENCH_SF_DIR`` with a ``noop`` write so every row is computed.
``value`` is the sum of the timed queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from concourse.registry import all_queries
from concourse.session import build_session

HEADLINE = [
    "recommend_batch",      # flagship: passes x catalog -> top 5 (passes/s in BASELINE)
    "hours_cover_window",   # candidate pairs whose hours cover the stay
    "exclusion_summary",
    "advisory_record",
    "card_explode",         # pages/s
    "embedded_json_extract",
    "ocr_confidence",       # words/s
    "bcbp_fields",
    "extract_route",
    "json_contract",
]
WARMUP_DIR = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus)))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=partitions, app_name="concourse-bench")
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    for n in names:
        run(qs[n](spark, WARMUP_DIR))
    # Let the warm-up's garbage (shuffle files, broadcasts, checkpoints released to
    # the context cleaner) be collected before timing, not during the first query.
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    times = {}
    for n in names:
        t0 = time.perf_counter()
        run(qs[n](spark, sf_dir))
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
