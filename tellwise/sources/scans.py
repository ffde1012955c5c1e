"""The row selections of each source: window bounds, guards and enumerations.

Each is a plain filter over a contract relation, so Spark pushes it into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import since


def state_log(warehouse_events: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """State changes inside the window."""
    return since(warehouse_events, "event_time", cfg.window_start)


def endpoint_queries(query_history: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Every statement in the window that ran on a warehouse, whatever its fate."""
    return since(query_history, "start_time", cfg.window_start) \
        .where("warehouse_id IS NOT NULL")


def finished_selects(query_history: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Finished SELECT statements in the window, however short."""
    return since(query_history, "start_time", cfg.window_start).where(
        (F.col("statement_type") == "SELECT")
        & (F.col("execution_status") == "FINISHED"))


def warehouse_usage(usage: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Usage that started in the window and names a warehouse."""
    return since(usage, "usage_start_time", cfg.window_start) \
        .where("warehouse_id IS NOT NULL")


def job_usage(usage: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Job usage that started in the window and names a job."""
    return since(usage, "usage_start_time", cfg.window_start).where(
        (F.col("billing_origin_product") == "JOBS") & F.col("job_id").isNotNull())


def prices_in(list_prices: DataFrame, currency: str = "USD") -> DataFrame:
    return list_prices.where(F.col("currency_code") == currency)


def ended_runs(job_runs: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Run periods that started in the window and have ended."""
    return since(job_runs, "period_start_time", cfg.window_start) \
        .where("period_end_time IS NOT NULL")


def table_edges(lineage: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Edges from a named table, bounded by calendar day."""
    return lineage.where(
        (F.col("event_date") >= F.lit(cfg.window_start_date))
        & (F.col("source_type") == "TABLE")
        & F.col("source_table_full_name").isNotNull())
