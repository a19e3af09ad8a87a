"""Headline benchmark: prints ONE JSON line with per-query wall times.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3; the median is reported).  Each query is executed
end to end with the no-op sink, after one warm-up pass over all queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from equilens.registry import all_queries  # noqa: E402
from equilens.session import build_session  # noqa: E402

HEADLINE = [
    "confusion_by_group", "fairness_all", "overall_fairness", "column_profile", "data_bias",
    "epsilon", "epsilon_num_b_cat_b", "diff_num_c", "bm_rebin_choice", "mi_importance",
    "transform_validity", "bm_iteration",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "16g"})
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    for n in names:               # warm-up: JIT, file listing, parquet footers
        run(qs[n](spark, sf_dir))
    times = {}
    for n in names:
        t = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(qs[n](spark, sf_dir))
            t.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(t), 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeats": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
