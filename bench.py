"""Time the headline queries and print one JSON line.

Every query runs from the driver tables to a discarded result, once to warm up and then
BENCH_RUNS times; the median counts. "spread" has the fastest and slowest run, "rows" the rows and "shuffle_mb" the
megabytes shuffled by the last run. 'build_all' is the writing of all layers, 'layered'
entries compute the same reports from the stored staging and mart tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewinds.plans.warehouse import build_all, over_layers
from tradewinds.registry import all_queries
from tradewinds.sources.driver_tables import DriverTables
from tradewinds.sources.sinks import scratch_folder

HEADLINE = [
    "stg_orders",
    "stg_geolocation",
    "fact_order_items",
    "base_customer_monthly_purchase",
    "kpi_monthly_core",
    "kpi_monthly_cancellation",
    "cohort_monthly_core",
    "cohort_pivot_retention",
    "orphan_count",
    "flag_snapshot",
    "referential_summary",
    "cross_table_event_order",
]
LAYERED = ["base_customer_monthly_purchase", "kpi_monthly_core", "kpi_monthly_cancellation", "cohort_monthly_core"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tradewinds-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffled_bytes(spark: SparkSession) -> int:
    """Shuffle bytes written by all stages that the session still remembers."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    nothing = context._jvm.java.util.ArrayList()
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(nothing, False, False, quantiles, nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def measured(spark: SparkSession, build: Callable[[], DataFrame], runs: int) -> dict[str, object]:
    taken, before = [], 0
    for _ in range(runs + 1):
        before = shuffled_bytes(spark)
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    moved = shuffled_bytes(spark) - before
    timed = taken[1:]
    return {
        "sec": round(statistics.median(timed), 3),
        "spread": [round(min(timed), 3), round(max(timed), 3)],
        "rows": build().count(),
        "shuffle_mb": round(moved / 1e6, 3),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark, registered = session(cpus), all_queries()
    found = {name: measured(spark, lambda n=name: registered[n](spark, folder), runs) for name in HEADLINE}
    start = time.perf_counter()
    stored = build_all(DriverTables(spark, folder).raw, scratch_folder(spark, "bench"))
    built = round(time.perf_counter() - start, 3)
    for name in LAYERED:
        found[f"layered_{name}"] = measured(spark, lambda n=name: over_layers(stored, "stg", "dm").table(n), runs)
    times = {name: one["sec"] for name, one in found.items()} | {"build_all": built}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median wall times",
                "value": round(sum(times[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "runs": runs,
                "details": {name: {k: v for k, v in one.items() if k != "sec"} for name, one in found.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
