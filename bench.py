"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up, then RUNS times; its figure is the median. Results
are written to the no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import calstack as cs
from calstack import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def lineitem(spark, *words):
    program = cs.facts(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"), "l_shipdate", {"x": ("sum", "l_quantity")})
    for w in words:
        program = program + w
    return program


def benchmarks(spark, root):
    from calstack.sources.store import Store

    first = cs.pull.cols[0].copy
    cumulative = [first + cs.resolve(f"c{n}") for n in ("add", "sub", "mul", "avg", "std", "var", "min", "max", "lag", "dif", "ret")]
    store = Store(f"{root}/store")
    slots = cs.CALENDARS["B"]["2015-01-01":"2025-01-01"]
    wide = spark.range(slots.start, slots.stop).select(slots.periodicity.end_column(F.col("id")).alias("date"), *((F.col("id") * (i + 1) % 1009).cast("double").alias(f"s{i}") for i in range(100)))

    def stored():
        store.delete_all()
        store.write("wide", wide)
        return cs.load("wide#s5*", store).rows["2020-01-01":"2021-01-01"]

    return {
        "p1_moving_average_deviation": lambda: queries.QUERIES["moving_average_deviation"](spark, SF_DIR),
        "p2_resample_lineitem": lambda: queries.QUERIES["monthly_lineitem"](spark, SF_DIR),
        "p3_cumulative_words": lambda: lineitem(spark, *cumulative).rows["1995-01-02":"2001-11-05"],
        "p4_rolling_std": lambda: lineitem(spark, first + cs.rstd(5), first + cs.rstd(250), first + cs.rstd(2000)).rows["1995-01-02":"2001-11-05"],
        "p5_exponential": lambda: lineitem(spark, first + cs.ewm_mean(20), first + cs.ewm_std(20)).rows["1995-01-02":"2001-11-05"],
        "p6_panel": lambda: queries.QUERIES["panel"](spark, SF_DIR),
        "p7_store": stored,
    }


def main() -> None:
    import tempfile

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = "file://" + tempfile.mkdtemp(prefix="calstack-bench-")
    took = {}
    for name, query in benchmarks(spark, root).items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
