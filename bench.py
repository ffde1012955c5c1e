"""Time the headline queries end to end and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1). Each query is run once unmeasured, to warm the JVM up,
and then BENCH_REPEAT times; the best time counts. A run plans the query afresh
and reads the test tables; the result goes to Spark's no-op sink, so whole rows
are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import registered

HEADLINE = (
    "utilized_seconds", "utilized_seconds_sweep", "query_stats", "peak_concurrency",
    "warehouse_cost", "job_billing", "heavy_query_signatures", "hot_tables",
    "subsecond_bi", "job_run_stats", "warehouse_recos", "query_table_recos",
    "job_recos", "exec_kpis", "top_actions", "digest_payload",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(repeat)), 3)
    for name, value in seconds.items():
        print(f"{name:26}{value:8.3f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
