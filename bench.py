"""Run the headline queries once each and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every
query runs over its whole tables; one run of a small query warms the session.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from perilweave.catalog import load
from perilweave.session import local_session

QUERIES = (
    "flagship_worst_years", "g18_tvar", "g21_euler_allocation", "g24_bucket_summary", "g25_exceedance_curve",
    "g27_joint_peril_probability", "w1_decile_group", "j11_apportion", "j1_lookup_or_median", "s17_backtest_index",
    "j5_overlay_area", "g5_pixel_fraction", "j8_knn_join", "s14_scenario_repricing", "s13_rating_table",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.TemporaryDirectory(prefix="spark-bench-")
    parts = max(int(cpus) if cpus.isdigit() else 8, 2)
    spark = local_session(cpus, partitions=parts, name="bench", shared=f"file://{shared.name}", memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = load()[0], {}
    queries["w7_first_rank"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in QUERIES:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    shared.cleanup()


if __name__ == "__main__":
    main()
