"""Benchmark: the delay pipeline and its report, statistics and model queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``pipeline`` is load -> profile-free clean -> preprocess -> features, written
once; every other entry is timed on top of it (results fully computed:
collected when small, written to the no-op sink when large).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketlens.plans import registry  # noqa: E402
from ticketlens.plans.pipelines import delay_stages  # noqa: E402
from ticketlens.session import get_spark  # noqa: E402

LARGE = {"tickets_raw", "clean_tickets", "preprocessed_tickets", "featured_tickets", "csat_features",
         "train_test_split", "random_split", "keyword_remarks", "parsed_text_times", "prepared_numeric"}


def run(df, name):
    if name in LARGE:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = set(os.environ.get("BENCH_QUERIES", "").split(",")) - {""}
    spark = get_spark(f"local[{cpus}]", cpus * 2, app_name="ticketlens-bench")
    times = {}
    t0 = time.time()
    st = delay_stages(spark, sf_dir)
    times["pipeline"] = round(time.time() - t0, 3)
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        run(fn(spark, sf_dir), name)
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "rows": {"tickets_featured": st.featured.count()}}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
