"""Time every report on one folder of test tables and print one JSON line.

Each report runs from the raw tables to its last row ``BENCH_RUNS`` + 1 times. The first run is
cold; ``queries`` holds the fastest of the rest and ``value`` their sum.

BENCH_SF_DIR   folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default all)
BENCH_RUNS     warm runs per report (default 2)
BENCH_QUERIES  comma-separated names (default all)
"""

from __future__ import annotations

import json
import os
import subprocess
import time
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame

from tillpath.plans.catalog import CATALOG
from tillpath.session import builder


def _seconds(make) -> float:
    start = time.perf_counter()
    frame: DataFrame = make()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _revision() -> str:
    try:
        command = ["git", "rev-parse", "--short", "HEAD"]
        here = Path(__file__).resolve().parent
        return subprocess.run(command, cwd=here, capture_output=True, text=True).stdout.strip()
    except OSError:
        return ""


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(CATALOG)
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        times = [_seconds(lambda: CATALOG[name](spark, folder)) for _ in range(runs + 1)]
        cold[name] = round(times[0], 3)
        warm[name] = round(min(times[1:] or times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "warm seconds, all reports from raw tables",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": pyspark.__version__,
                "revision": _revision(),
            }
        )
    )


if __name__ == "__main__":
    main()
