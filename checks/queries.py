"""The registered queries: every operator and report over the projected telemetry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.profiles import DEFAULT, RECENT, TIGHT, ZERO_FLOOR
from checks.telemetry import telemetry
from tellwise import Recommendations, Telemetry, Thresholds, recommend
from tellwise.functions import fingerprint, half_up
from tellwise.operators.intervals import (
    activity, on_time, overlap_seconds, peak_per_bucket, state_intervals,
)
from tellwise.operators.latest import current_jobs, current_warehouses
from tellwise.operators.pricing import job_billing, warehouse_cost
from tellwise.operators.stats import query_stats, run_stats
from tellwise.operators.workload import heavy_queries, repeated_statements, signature_rollup
from tellwise.plans import jobs, rollups, warehouses, workloads
from tellwise.plans.actions import consolidated_actions, top_actions
from tellwise.plans.confidence import confidence_label, pick
from tellwise.plans.digest import briefing_text, digest_payload
from tellwise.plans.store import ResultStore
from tellwise.sources import scans
from tellwise.sources.scans import endpoint_queries, finished_selects, state_log

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


def _micros(column: str) -> Column:
    whole = F.unix_timestamp(column)
    return whole * 1000000 + F.expr(f"bigint(extract(second from {column}) * 1000000) % 1000000")


def _log(data: Telemetry) -> DataFrame:
    return state_log(data.warehouse_events, cfg=DEFAULT)


def _intervals(data: Telemetry) -> DataFrame:
    return state_intervals(_log(data))


def _state_intervals(data: Telemetry) -> DataFrame:
    return _intervals(data).select(
        "warehouse_id", _micros("w_start").alias("w_start_us"),
        _micros("w_end").alias("w_end_us"), "cluster_count")


def _utilized_join(data: Telemetry) -> DataFrame:
    used = overlap_seconds(
        _log(data), endpoint_queries(data.query_history, cfg=DEFAULT), method="join")
    return on_time(_intervals(data)).select("warehouse_id").join(
        used, "warehouse_id", "left").select(
        "warehouse_id", F.coalesce("util_s", F.lit(0)).alias("util_s"))


def _utilized_sweep(data: Telemetry) -> DataFrame:
    """The same from one pass, which also tells which warehouses were on."""
    return activity(_log(data), endpoint_queries(data.query_history, cfg=DEFAULT)) \
        .where("on_s IS NOT NULL").select("warehouse_id", "util_s")


def _base(data: Telemetry) -> DataFrame:
    base = warehouses.warehouse_base(data, cfg=DEFAULT)
    return _rounded(base, 4, "hours_on", "hours_utilized", "hours_idle", "dollars_30d").select(
        "warehouse_id", "warehouse_name", "warehouse_size", "warehouse_type",
        "auto_stop_minutes", "max_clusters", "hours_on", "hours_utilized", "hours_idle",
        "util_pct", "query_count", "peak_concurrent", "dollars_30d")


def _signatures(data: Telemetry) -> DataFrame:
    heavy = heavy_queries(data.query_history, cfg=DEFAULT)
    return signature_rollup(heavy, cfg=DEFAULT).select(
        "query_signature", "n", "ms", "read_b", "sample")


def _findings(data: Telemetry) -> DataFrame:
    heavy = heavy_queries(data.query_history, cfg=DEFAULT)
    return workloads.signature_findings(signature_rollup(heavy, cfg=DEFAULT), cfg=DEFAULT)


def _signals(data: Telemetry) -> DataFrame:
    derived = ("startup_share", "p95_p50_ratio", "failure_rate_pct", "runs_per_day")
    return _rounded(jobs.job_signals(data, cfg=DEFAULT), 6, *derived).select(
        *jobs.JOB_KEY, "job_name", "creator_id", "run_count_30d", *derived)


def _scores(data: Telemetry) -> DataFrame:
    columns = [f"score_{s}" for s in jobs.POINTS]
    scored = jobs.score_jobs(jobs.job_signals(data, cfg=DEFAULT), cfg=DEFAULT)
    return _rounded(scored, 6, *columns).select(*jobs.JOB_KEY, *columns)


def _labelled(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.select(*columns, "confidence",
                           confidence_label(F.col("confidence")).alias("confidence_label"))


def _picked(r: Recommendations) -> DataFrame:
    """The multi-select filters on category, fit bucket and migration risk."""
    def rows(source: str, findings: DataFrame, label: str, item: str) -> DataFrame:
        return findings.select(F.lit(source).alias("source"), F.col(label).alias("label"),
                               F.col(item).alias("item"))
    return reduce(DataFrame.unionByName, [
        rows("warehouse", pick(r.warehouse, category=["DECOMMISSION_CANDIDATE", "RIGHTSIZE"]),
             "category", "warehouse_id"),
        rows("query_table", pick(r.query_table, category=["HOT_TABLE_REVIEW", "HIGH_SPILL_QUERY"]),
             "category", "target_or_sample"),
        rows("jobs", pick(r.jobs, fit_bucket=["60-79 (Good)", "40-59 (Marginal)"],
                          migration_risk=["BLOCKER"]), "fit_bucket", "job_id")])


def _sets(r: Recommendations) -> tuple[DataFrame, DataFrame, DataFrame]:
    return r.warehouse, r.query_table, r.jobs


def _scanned(data: Telemetry) -> DataFrame:
    """Rows each source offers to each analysis in a two-week window."""
    selections = {
        "warehouses": data.warehouses,
        "warehouse_events": scans.state_log(data.warehouse_events, cfg=RECENT),
        "query_history_all": scans.endpoint_queries(data.query_history, cfg=RECENT),
        "query_history_selects": scans.finished_selects(data.query_history, cfg=RECENT),
        "query_history_heavy": heavy_queries(data.query_history, cfg=RECENT),
        "usage_sql": scans.warehouse_usage(data.usage, cfg=RECENT),
        "usage_jobs": scans.job_usage(data.usage, cfg=RECENT),
        "list_prices": scans.prices_in(data.list_prices),
        "jobs": data.jobs,
        "job_runs": scans.ended_runs(data.job_runs, cfg=RECENT),
        "lineage": scans.table_edges(data.lineage, cfg=RECENT),
    }
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("selection"), "n")
        for name, df in selections.items()])


def _text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query fingerprint over whole documents: texts alike but for literals."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.groupBy(fingerprint(F.col("text")).alias("shape")).agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc_id"))


# operators over the telemetry
_OPERATORS: dict[str, Callable[[Telemetry], DataFrame]] = {
    "scanned_rows": _scanned,
    "latest_warehouse": lambda d: current_warehouses(d.warehouses).drop("change_time"),
    "latest_job": lambda d: current_jobs(d.jobs).drop("change_time"),
    "state_intervals": _state_intervals,
    "on_time": lambda d: on_time(_intervals(d)),
    "utilized_seconds": _utilized_join,
    "utilized_seconds_sweep": _utilized_sweep,
    "query_stats": lambda d: _rounded(
        query_stats(endpoint_queries(d.query_history, cfg=DEFAULT)), 6,
        "avg_queue_s", "spill_gb"),
    "peak_concurrency": lambda d: peak_per_bucket(
        endpoint_queries(d.query_history, cfg=DEFAULT), "warehouse_id", "start_time"),
    "warehouse_cost": lambda d: _rounded(
        warehouse_cost(d.usage, d.list_prices, cfg=DEFAULT), 4, "dbus_30d", "dollars_30d"),
    "job_billing": lambda d: _rounded(
        job_billing(d.usage, d.list_prices, cfg=DEFAULT), 4,
        "classic_dbus_30d", "serverless_dbus_30d", "classic_dbu_cost_30d"),
    "warehouse_base": _base,
    "heavy_query_signatures": _signatures,
    "repeated_statements": lambda d: repeated_statements(d.query_history),
    "expensive_queries": lambda d: workloads.expensive_queries(_findings(d), cfg=DEFAULT),
    "mv_candidates": lambda d: workloads.threshold_queries(_findings(d), workloads.REPEATED),
    "low_pruning": lambda d: workloads.threshold_queries(_findings(d), workloads.LOW_PRUNING),
    "high_spill": lambda d: workloads.threshold_queries(_findings(d), workloads.HIGH_SPILL),
    "hot_tables": lambda d: workloads.hot_tables(
        d.lineage, heavy_queries(d.query_history, cfg=DEFAULT), cfg=DEFAULT),
    "subsecond_bi": lambda d: workloads.fast_bi_warehouses(
        finished_selects(d.query_history, cfg=DEFAULT), d.warehouses, cfg=DEFAULT),
    "job_run_stats": lambda d: _rounded(
        run_stats(d.job_runs, cfg=DEFAULT), 6, "avg_run_minutes", "p50_run_minutes",
        "p95_run_minutes", "short_run_share_pct"),
    "job_signals": _signals,
    "job_scores": _scores,
    "warehouse_recos": lambda d: warehouses.in_report_order(
        warehouses.recommend_warehouses(d, cfg=DEFAULT)),
    "warehouse_recos_tight": lambda d: warehouses.in_report_order(
        warehouses.recommend_warehouses(d, cfg=TIGHT)),
    "warehouse_recos_zero_floor": lambda d: warehouses.in_report_order(
        warehouses.recommend_warehouses(d, cfg=ZERO_FLOOR)),
    "query_table_recos": lambda d: workloads.in_report_order(
        workloads.recommend_workloads(d, cfg=DEFAULT)),
    "job_recos": lambda d: jobs.in_report_order(jobs.recommend_jobs(d, cfg=DEFAULT)),
}

# reports over the scored sets: (profile, sets needed, report)
_ALL = ("warehouse", "query_table", "jobs")
_REPORTS: dict[str, tuple[Thresholds, tuple[str, ...], Callable[[Recommendations], DataFrame]]] = {
    "warehouse_recos_recent": (RECENT, _ALL[:1], lambda r: r.ordered().warehouse),
    "query_table_recos_recent": (RECENT, _ALL[1:2], lambda r: r.ordered().query_table),
    "job_recos_recent": (RECENT, _ALL[2:], lambda r: r.ordered().jobs),
    "wh_confidence": (DEFAULT, _ALL[:1],
                      lambda r: _labelled(r.warehouse, "warehouse_id", "category")),
    "qt_confidence": (DEFAULT, _ALL[1:2],
                      lambda r: _labelled(r.query_table, "category", "target_or_sample",
                                          "exec_count", "total_compute_s")),
    "jb_confidence": (DEFAULT, _ALL[2:], lambda r: _labelled(r.jobs, *jobs.JOB_KEY)),
    "picked_findings": (DEFAULT, _ALL, _picked),
    "exec_kpis": (DEFAULT, _ALL, lambda r: rollups.exec_kpis(*_sets(r))),
    "exec_kpis_jobs_only": (DEFAULT, _ALL[2:], lambda r: rollups.exec_kpis(*_sets(r))),
    "overview_counters": (DEFAULT, _ALL, lambda r: rollups.overview(*_sets(r))),
    "wh_by_category": (DEFAULT, _ALL[:1],
                       lambda r: rollups.warehouses_by_category(r.warehouse)),
    "qt_by_category": (DEFAULT, _ALL[1:2],
                       lambda r: rollups.workloads_by_category(r.query_table)),
    "jb_by_bucket": (DEFAULT, _ALL[2:], lambda r: rollups.jobs_by_bucket(r.jobs)),
    "jb_by_risk": (DEFAULT, _ALL[2:], lambda r: rollups.jobs_by_risk(r.jobs)),
    "top_warehouses": (DEFAULT, _ALL[:1], lambda r: rollups.top_warehouses(r.warehouse)),
    "job_fit_vs_spend": (DEFAULT, _ALL[2:], lambda r: rollups.job_fit_vs_spend(r.jobs)),
    "wh_table": (DEFAULT, _ALL[:1], lambda r: rollups.warehouse_table(r.warehouse)),
    "qt_table": (DEFAULT, _ALL[1:2], lambda r: rollups.workload_table(r.query_table)),
    "jb_table": (DEFAULT, _ALL[2:], lambda r: rollups.job_table(r.jobs)),
    "top_actions": (DEFAULT, _ALL, lambda r: top_actions(consolidated_actions(*_sets(r)))),
    "digest_payload": (DEFAULT, _ALL, lambda r: digest_payload(*_sets(r))),
    "briefing_text": (DEFAULT, _ALL, lambda r: briefing_text(*_sets(r))),
    "briefing_subset": (DEFAULT, _ALL[:1], lambda r: briefing_text(*_sets(r))),
    "job_prompt_text": (DEFAULT, _ALL[2:],
                        lambda r: jobs.job_prompt(r.jobs).select(*jobs.JOB_KEY, "prompt_text")),
}


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job findings, read back from the result store."""
    found = ResultStore(spark).get(telemetry(spark, sf_dir), cfg=DEFAULT, selected=_ALL[2:])
    return _labelled(found.jobs, *jobs.JOB_KEY, "fit_score", "classic_dbu_cost_30d")


def registered() -> dict[str, Query]:
    """Query name -> function of (session, folder of the test tables)."""
    def operator(build: Callable[[Telemetry], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(telemetry(spark, sf_dir))

    def report(cfg: Thresholds, selected: tuple[str, ...],
               build: Callable[[Recommendations], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(
            recommend(telemetry(spark, sf_dir), cfg=cfg, selected=selected))

    return {"text_fingerprints": _text_fingerprints, "stored_findings": _stored,
            **{name: operator(b) for name, b in _OPERATORS.items()},
            **{name: report(*spec) for name, spec in _REPORTS.items()}}
