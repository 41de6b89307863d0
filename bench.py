"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once cold and once warm (same session); a query is forced with
the ``noop`` sink, so the whole plan executes without shipping rows to the
driver.  Prints one JSON line; ``value`` is the sum of the warm times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from cohortlens.session import get_spark

    spark = get_spark(
        f"local[{cpus}]",
        app="cohortlens-bench",
        **{"spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus)))},
    )
    from cohortlens.plans.registry import HEADLINE, QUERIES, load_all

    load_all()
    names = only or list(HEADLINE)
    cold, warm = {}, {}
    for name in names:
        for store in (cold, warm):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "spark": spark.version,
                "master": f"local[{cpus}]",
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
