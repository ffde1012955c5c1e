"""Per-warehouse and per-job statistics over facts.

Each fact is first counted per (key, duration); totals and percentiles both come
from those counts, so one scan and one combined shuffle serve them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import epoch_seconds, gigabytes
from tellwise.operators.quantiles import summarise
from tellwise.sources.scans import ended_runs

# Terminations caused by infrastructure rather than by the job.
INFRA_FAILURES = (
    "CLUSTER_ERROR", "DRIVER_ERROR", "CLUSTER_REQUEST_LIMIT_EXCEEDED",
    "INSTANCE_UNREACHABLE", "UNEXPECTED_LAUNCH_FAILURE",
)
INIT_SCRIPT_FAILURE = "INIT_SCRIPT_FAILURE"


def query_stats(queries: DataFrame) -> DataFrame:
    """Volume, task-time percentiles, mean queue wait and spill per warehouse."""
    queued_ms = (F.coalesce("waiting_for_compute_duration_ms", F.lit(0))
                 + F.coalesce("waiting_at_capacity_duration_ms", F.lit(0)))
    by_duration = queries.groupBy("warehouse_id", "total_task_duration_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(queued_ms).alias("queued_ms"),
        F.sum("spilled_local_bytes").alias("spill_b"))
    stats = summarise(
        by_duration, ["warehouse_id"], value="total_task_duration_ms", weight="n",
        percents={"p50_ms": 50, "p95_ms": 95},
        sums={"query_count": F.col("n"), "queued_ms": F.col("queued_ms"), "spill_b": F.col("spill_b")})
    return stats.select(
        "warehouse_id", "query_count",
        (F.col("p50_ms") / F.lit(1000.0)).alias("p50_task_s"),
        (F.col("p95_ms") / F.lit(1000.0)).alias("p95_task_s"),
        (F.col("queued_ms") / F.col("query_count") / F.lit(1000.0)).alias("avg_queue_s"),
        gigabytes(F.col("spill_b")).alias("spill_gb"))


def run_stats(job_runs: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Run counts, durations and failures per job over ended periods.

    ``run_count_30d`` counts distinct runs; everything else counts timeline rows.
    Rows that name no job are left out, as no job can match them.
    """
    job = ["workspace_id", "job_id"]
    ended = ended_runs(job_runs, cfg=cfg).where(
        "workspace_id IS NOT NULL AND job_id IS NOT NULL")
    seconds = (epoch_seconds(F.col("period_end_time"))
               - epoch_seconds(F.col("period_start_time")))
    by_duration = ended.groupBy(*job, seconds.alias("run_s")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("result_state") == "FAILED").alias("failed_runs"),
        F.count_if(F.col("termination_code").isin(*INFRA_FAILURES))
         .alias("infra_failure_count"),
        F.count_if(F.col("termination_code") == INIT_SCRIPT_FAILURE)
         .alias("init_script_failure_count"))
    n, run_s = F.col("n"), F.col("run_s")
    short = run_s / F.lit(60.0) < F.lit(float(cfg.short_run_threshold_minutes))
    counts = ("failed_runs", "infra_failure_count", "init_script_failure_count")
    rows = summarise(
        by_duration, job, value="run_s", weight="n", percents={"p50_s": 50, "p95_s": 95},
        sums={"rows": n, "whole_s": run_s * n, "short": F.when(short, n).otherwise(0),
              **{c: F.col(c) for c in counts}})
    runs = (ended.where("run_id IS NOT NULL").select(*job, "run_id").distinct()
                 .groupBy(*job).agg(F.count(F.lit(1)).alias("run_count_30d")))
    return rows.join(runs, job, "left").select(
        *job, F.coalesce("run_count_30d", F.lit(0)).alias("run_count_30d"),
        (F.col("whole_s") / F.col("rows") / F.lit(60.0)).alias("avg_run_minutes"),
        (F.col("p50_s") / F.lit(60.0)).alias("p50_run_minutes"),
        (F.col("p95_s") / F.lit(60.0)).alias("p95_run_minutes"),
        (F.lit(100.0) * F.col("short") / F.col("rows")).alias("short_run_share_pct"), *counts)
