"""Headline figures, category totals and display projections of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.functions import half_up

# Assumed saving on job spend, months a year, what counts as a good fit.
JOB_SAVINGS_SHARE = 0.30
MONTHS = 12.0
GOOD_FIT = 70

# Columns of the detail tables.
WAREHOUSE_TABLE = (
    "warehouse_name", "category", "selection_criteria", "recommended_action",
    "current_size", "rec_size", "current_type", "rec_type", "utilization_pct",
    "idle_hours_30d", "current_cost_30d", "projected_cost_30d", "effective_savings_30d",
)
WORKLOAD_TABLE = (
    "category", "selection_criteria", "recommended_action", "target_or_sample",
    "exec_count", "total_compute_s", "avg_compute_s", "avg_spill_gb", "pruning_pct",
    "total_read_gb",
)
JOB_TABLE = (
    "job_name", "fit_score", "fit_bucket", "top_reasons", "migration_risk",
    "migration_checklist", "run_count_30d", "avg_run_minutes", "p95_p50_ratio",
    "startup_share_pct", "failure_rate_pct", "infra_failure_count",
    "init_script_failure_count", "classic_dbu_cost_30d",
)


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row relations."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _total(column: str) -> Column:
    return F.coalesce(half_up(F.sum(column), 2), F.lit(0.0))


def whole_row(parts: Sequence[DataFrame | None], **fallback: object) -> DataFrame:
    """The one-row relations that are there, side by side; columns that then are
    missing get their fallback."""
    there = [part for part in parts if part is not None]
    if not there:
        raise ValueError("no recommendation set was selected")
    row = side_by_side(*there)
    return row.withColumns({c: F.lit(v) for c, v in fallback.items() if c not in row.columns})


def exec_kpis(warehouses: DataFrame | None, workloads: DataFrame | None,
              jobs: DataFrame | None) -> DataFrame:
    """The headline figures as one row; empty and unselected sets count as zero."""
    wh = None if warehouses is None else warehouses.agg(
        F.count_distinct("warehouse_id").alias("wh_count"),
        _total("effective_savings_30d").alias("wh_savings_30d"),
        _total("current_cost_30d").alias("wh_current_spend_30d"))
    qt = None if workloads is None else workloads.agg(
        F.count(F.lit(1)).alias("qt_count"),
        F.coalesce(half_up(F.sum("total_compute_s") / F.lit(3600.0), 2), F.lit(0.0))
         .alias("qt_compute_hours"))
    jb = None if jobs is None else jobs.agg(
        F.count(F.lit(1)).alias("jb_count"),
        F.count_if(F.col("fit_score") >= GOOD_FIT).alias("jb_high_fit"),
        _total("classic_dbu_cost_30d").alias("jb_addressable_spend"))
    yearly = (F.col("wh_savings_30d")
              + F.lit(JOB_SAVINGS_SHARE) * F.col("jb_addressable_spend")) * F.lit(MONTHS)
    row = whole_row([wh, qt, jb], wh_count=0, wh_savings_30d=0.0, wh_current_spend_30d=0.0,
                    qt_count=0, qt_compute_hours=0.0, jb_count=0, jb_high_fit=0,
                    jb_addressable_spend=0.0)
    counts = {c: F.col(c).cast("bigint") for c in ("wh_count", "qt_count", "jb_count", "jb_high_fit")}
    return row.withColumns(counts).withColumn("annualized", half_up(yearly, 2))


def overview(warehouses: DataFrame | None, workloads: DataFrame | None,
             jobs: DataFrame | None) -> DataFrame:
    """The counters shown beside the findings; sums over nothing are NULL, and an
    unselected set has no columns."""
    return whole_row([
        None if warehouses is None else warehouses.agg(
            F.count("warehouse_id").alias("wh_count"),
            half_up(F.sum("effective_savings_30d"), 2).alias("wh_savings"),
            half_up(F.sum("current_cost_30d"), 2).alias("wh_current")),
        None if workloads is None else workloads.agg(
            F.count("category").alias("qt_count"),
            half_up(F.sum("compute_hours"), 2).alias("qt_hours"),
            F.sum("exec_count").alias("qt_executions")),
        None if jobs is None else jobs.agg(
            F.count("job_id").alias("jb_count"),
            half_up(F.sum("classic_dbu_cost_30d"), 2).alias("jb_spend"),
            F.sum("run_count_30d").alias("jb_runs"))])


def warehouses_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(
        half_up(F.sum("effective_savings_30d"), 2).alias("savings_30d"),
        F.count_distinct("warehouse_id").alias("warehouses"),
        F.count(F.lit(1)).alias("findings"),
    ).orderBy(F.col("savings_30d").desc_nulls_last(), "category")


def workloads_by_category(findings: DataFrame) -> DataFrame:
    seconds = F.sum(F.coalesce("total_compute_s", F.lit(0.0)))
    return findings.groupBy("category").agg(
        half_up(seconds / F.lit(3600.0), 2).alias("compute_hours"),
        F.count(F.lit(1)).alias("candidates"),
    ).orderBy(F.col("compute_hours").desc(), "category")


def jobs_by_bucket(findings: DataFrame) -> DataFrame:
    return findings.groupBy("fit_bucket").agg(
        F.count("job_id").alias("jobs"),
        half_up(F.sum("classic_dbu_cost_30d"), 2).alias("classic_dbu_cost_30d"),
        half_up(F.avg("pts_duration"), 2).alias("avg_pts_duration"),
    ).orderBy("fit_bucket")


def jobs_by_risk(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("migration_risk").agg(F.count("job_id").alias("jobs"))
                    .orderBy("migration_risk"))


def top_warehouses(findings: DataFrame, n: int = 10) -> DataFrame:
    return (findings
            .orderBy(F.col("effective_savings_30d").desc_nulls_last(), "warehouse_id")
            .limit(n)
            .select("warehouse_name", "category",
                    F.col("effective_savings_30d").alias("savings_30d"),
                    "current_cost_30d", "utilization_pct", "recommended_action"))


def job_fit_vs_spend(findings: DataFrame) -> DataFrame:
    at_risk = F.coalesce("init_script_failure_count", F.lit(0)) > 0
    return findings.select(
        "job_name", "fit_score", "classic_dbu_cost_30d", "run_count_30d",
        at_risk.alias("has_init_script_risk"), "avg_run_minutes", "p95_p50_ratio",
        "top_reasons")


def warehouse_table(findings: DataFrame) -> DataFrame:
    return findings.select(*WAREHOUSE_TABLE)


def workload_table(findings: DataFrame) -> DataFrame:
    return findings.select(*WORKLOAD_TABLE)


def job_table(findings: DataFrame) -> DataFrame:
    return findings.select(*JOB_TABLE)
