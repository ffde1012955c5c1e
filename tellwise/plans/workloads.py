"""Query and table recommendations: six detectors over two facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import decimal_text, gigabytes, half_up, nullif_zero, ranked, rule_ladder
from tellwise.operators.latest import latest
from tellwise.operators.workload import (
    heavy_queries, shared_by_statement, signature_rollup, table_reads, warehouse_traffic,
)
from tellwise.plans.labels import WORKLOAD_RULES
from tellwise.sources.scans import finished_selects
from tellwise.sources.telemetry import Telemetry

EXPENSIVE = "EXPENSIVE_QUERY_REVIEW"
REPEATED = "MATERIALIZED_VIEW_CANDIDATE"
LOW_PRUNING = "LIQUID_CLUSTERING_CANDIDATE"
HIGH_SPILL = "HIGH_SPILL_QUERY"
HOT_TABLE = "HOT_TABLE_REVIEW"
FAST_BI = "SUB_SECOND_BI_ENGINE_CANDIDATE"

TARGET_CHARS = 80


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _finding(category: str, action: list[str | Column], *, runs: Column, ms: Column,
             target: Column | None = None, sample: Column | None = None,
             avg_ms: Column | None = None, spill_gb: Column | None = None,
             pruning_pct: Column | None = None, read_b: Column | None = None) -> list[Column]:
    """The eleven columns every detector reports, absent ones NULL."""
    def number(value: Column | None, digits: int) -> Column:
        return F.lit(None).cast("double") if value is None else half_up(value, digits)

    def words(value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else value

    seconds = None if avg_ms is None else avg_ms / F.lit(1000.0)
    return [
        F.lit(category).alias("category"),
        F.lit(WORKLOAD_RULES[category]).alias("selection_criteria"),
        F.concat(*[_text(part) for part in action]).alias("recommended_action"),
        words(target).alias("target"),
        words(sample).alias("query_sample"),
        runs.cast("bigint").alias("exec_count"),
        half_up(ms / F.lit(1000.0), 1).alias("total_compute_s"),
        number(seconds, 2).alias("avg_compute_s"),
        number(spill_gb, 2).alias("avg_spill_gb"),
        number(pruning_pct, 1).alias("pruning_pct"),
        number(None if read_b is None else gigabytes(read_b), 2).alias("total_read_gb"),
    ]


def signature_findings(rollup: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Four findings per signature, each with a ``keep`` flag for its thresholds.

    All four come out of one row, so one pass over the history feeds the four
    detectors. The expensive-query finding is always kept here; its rule ranks
    signatures against each other and is applied in ``expensive_queries``.
    """
    n, ms = F.col("n"), F.col("ms")
    minutes = decimal_text(ms / F.lit(60000.0), 1)
    common = dict(runs=n, ms=ms, avg_ms=ms / n, sample=F.col("sample"),
                  read_b=F.col("read_b"))

    big_n, big_ms, big_read = F.col("big_n"), F.col("big_ms"), F.col("big_read_b")
    pruned = F.col("big_pruned_b")
    pruning_pct = (pruned.cast("double") * F.lit(100.0)
                   / nullif_zero((big_read + pruned).cast("double")))
    spill_n, spill_ms = F.col("spill_n"), F.col("spill_ms")
    spill_gb = gigabytes(F.col("spill_b") / nullif_zero(spill_n))

    findings = [
        (F.lit(True), _finding(
            EXPENSIVE,
            ["Top query - ", n, " runs, ", minutes, " min total. ",
             "Open the query profile / review with AI for tuning."], **common)),
        ((n >= cfg.mv_min_executions) & (ms / F.lit(1000.0) >= cfg.mv_min_total_compute_s),
         _finding(
            REPEATED,
            ["Run ", n, "x - total ", minutes, " min compute. ",
             "CREATE MATERIALIZED VIEW."], **common)),
        ((big_n >= cfg.pruning_min_executions) & (pruning_pct < cfg.pruning_max_pct),
         _finding(
            LOW_PRUNING,
            ["Reads ", decimal_text(gigabytes(big_read), 1), " GB with only ",
             decimal_text(pruning_pct, 1), "% pruned over ", big_n, " runs. ",
             "ALTER TABLE ... CLUSTER BY (filter columns)."],
            runs=big_n, ms=big_ms, avg_ms=big_ms / nullif_zero(big_n),
            sample=F.col("big_sample"), pruning_pct=pruning_pct, read_b=big_read)),
        ((spill_n >= cfg.spill_min_executions) & (spill_gb >= cfg.spill_min_avg_gb),
         _finding(
            HIGH_SPILL,
            ["Avg ", decimal_text(spill_gb, 1), " GB spill / query over ", spill_n, " runs. ",
             "Size up warehouse or rewrite (broadcast joins, narrow projections)."],
            runs=spill_n, ms=spill_ms, avg_ms=spill_ms / nullif_zero(spill_n),
            sample=F.col("spill_sample"), spill_gb=spill_gb)),
    ]
    rows = F.array(*[F.struct(F.coalesce(keep, F.lit(False)).alias("keep"), *columns)
                     for keep, columns in findings])
    return rollup.select("query_signature", F.inline(rows))


def expensive_queries(findings: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """The N signatures with the most compute; equal totals go by signature."""
    return (findings.where(F.col("category") == EXPENSIVE)
                    .orderBy(F.col("total_compute_s").desc(), "query_signature")
                    .limit(cfg.top_expensive_queries_n)
                    .drop("query_signature", "keep"))


def threshold_queries(findings: DataFrame, *categories: str) -> DataFrame:
    """Signature findings that met the thresholds of their category."""
    wanted = categories or (REPEATED, LOW_PRUNING, HIGH_SPILL)
    return (findings.where(F.col("keep") & F.col("category").isin(*wanted))
                    .drop("query_signature", "keep"))


def hot_tables(lineage: DataFrame, heavy: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Tables many statements read and heavy queries spend time on.

    ``avg_spill_gb`` carries the total here.
    """
    reads = table_reads(lineage, heavy, cfg=cfg).where(
        (F.col("readers") >= cfg.hot_table_min_queries)
        & (F.coalesce(F.col("ms") / F.lit(1000.0), F.lit(0.0)) >= cfg.hot_table_min_compute_s))
    return reads.select(*_finding(
        HOT_TABLE,
        ["Read by ", F.col("readers"), " queries / ", F.col("users"), " users. ",
         "High-leverage target - review LIQUID CLUSTERING + "
         "ENABLE PREDICTIVE OPTIMIZATION."],
        runs=F.col("readers"), ms=F.col("ms"), target=F.col("source_table_full_name"),
        spill_gb=gigabytes(F.col("spill_b")), read_b=F.col("read_b")))


def fast_bi_warehouses(selects: DataFrame, warehouses: DataFrame, *,
                       cfg: Thresholds) -> DataFrame:
    """Warehouses with many short statements from several users.

    Names are attached after the reduction, so only kept warehouses are joined.
    """
    traffic = warehouse_traffic(selects).where(
        (F.col("n") >= cfg.subsecond_min_queries)
        & (F.col("p50_s") < cfg.subsecond_max_p50_s)
        & (F.col("users") >= cfg.subsecond_min_distinct_users))
    names = latest(warehouses.select("warehouse_id", "warehouse_name", "change_time"),
                   ["warehouse_id"], "change_time", ["warehouse_name"]).drop("change_time")
    target = F.concat(F.lit("warehouse: "), F.coalesce("warehouse_name", F.lit("?")),
                      F.lit(" ("), F.col("warehouse_id"), F.lit(")"))
    return traffic.join(names, "warehouse_id", "left").select(*_finding(
        FAST_BI,
        [F.col("n"), " queries / ", F.col("users"), " users / p50 ",
         decimal_text(F.col("p50_s"), 2), "s, p95 ", decimal_text(F.col("p95_s"), 2), "s. ",
         "High-volume BI workload - qualifies for sub-second BI engine evaluation."],
        runs=F.col("n"), ms=F.col("ms"), target=target,
        avg_ms=F.col("ms") / nullif_zero(F.col("timed")), read_b=F.col("read_b")))


def with_display_columns(findings: DataFrame) -> DataFrame:
    sample = F.substring("query_sample", 1, TARGET_CHARS)
    return findings.select(
        "category", "selection_criteria", "recommended_action",
        F.coalesce("target", sample).alias("target_or_sample"),
        "target", "query_sample", "exec_count", "total_compute_s",
        (F.col("total_compute_s") / F.lit(3600.0)).alias("compute_hours"),
        "avg_compute_s", "avg_spill_gb", "pruning_pct", "total_read_gb")


def in_report_order(findings: DataFrame) -> DataFrame:
    rank = rule_ladder([(F.col("category") == name, F.lit(i))
                        for i, name in enumerate(WORKLOAD_RULES)])
    return ranked(findings, ["category", "total_compute_s", "target_or_sample"], rank,
                  F.col("total_compute_s").desc_nulls_last(), "target_or_sample",
                  "recommended_action")


def recommend_workloads(data: Telemetry, *, cfg: Thresholds) -> DataFrame:
    """All six detectors. A signature may be reported by several of them."""
    history, lineage, warehouses = data.need("query_history", "lineage", "warehouses")
    heavy = shared_by_statement(heavy_queries(history, cfg=cfg))
    signatures = signature_findings(signature_rollup(heavy, cfg=cfg), cfg=cfg)
    branches = [
        fast_bi_warehouses(finished_selects(history, cfg=cfg), warehouses, cfg=cfg),
        expensive_queries(signatures, cfg=cfg),
        threshold_queries(signatures),
        hot_tables(lineage, heavy, cfg=cfg),
    ]
    return with_display_columns(reduce(DataFrame.unionByName, branches))
