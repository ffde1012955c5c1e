"""Rules of the three recommendation sets, one trap at a time."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tellwise import Telemetry, Thresholds, recommend
from tellwise.plans import jobs, warehouses, workloads
from tellwise.plans.actions import consolidated_actions, top_actions
from tellwise.plans.confidence import (
    confidence_label, executive_filter, job_confidence, pick, warehouse_confidence,
    workload_confidence,
)
from tellwise.plans.digest import briefing_text, digest_payload
from tellwise.plans.rollups import exec_kpis, overview

CFG = Thresholds(as_of=datetime(2024, 1, 31))

BASE = ("warehouse_id string, warehouse_name string, warehouse_size string,"
        " warehouse_type string, auto_stop_minutes bigint, max_clusters bigint,"
        " hours_on double, hours_utilized double, hours_idle double, util_pct double,"
        " query_count bigint, p50_task_s double, p95_task_s double, avg_queue_s double,"
        " spill_gb double, peak_concurrent bigint, dollars_30d double")
NORMAL = dict(
    warehouse_id="w", warehouse_name="wh", warehouse_size="MEDIUM", warehouse_type="SERVERLESS",
    auto_stop_minutes=5, max_clusters=1, hours_on=10.0, hours_utilized=9.0, hours_idle=1.0,
    util_pct=90.0, query_count=100, p50_task_s=40.0, p95_task_s=90.0, avg_queue_s=1.0,
    spill_gb=0.0, peak_concurrent=5, dollars_30d=100.0)


def assess(spark, cfg=CFG, **changes):
    names = [c.split()[0] for c in BASE.split(", ")]
    row = {**NORMAL, **changes}
    base = spark.createDataFrame([tuple(row[n] for n in names)], BASE)
    return warehouses.assess_warehouses(base, cfg=cfg)


def verdict(spark, cfg=CFG, **changes):
    return assess(spark, cfg, **changes).first()


def reported(spark, cfg=CFG, **changes):
    return warehouses.worth_reporting(assess(spark, cfg, **changes), cfg=cfg).count()


# warehouses

def test_healthy_warehouse_has_no_category(spark):
    r = verdict(spark)
    assert (r["category"], r["recommended_action"]) == (None, None)
    assert reported(spark) == 0


@pytest.mark.parametrize("changes, category, action", [
    (dict(query_count=None, peak_concurrent=None), "DECOMMISSION_CANDIDATE",
     "DELETE - 0 queries / 30d, $100.00 burned"),
    (dict(warehouse_type="CLASSIC", util_pct=10.0, hours_utilized=1.0), "COST_REDUCE",
     "MIGRATE CLASSIC -> SERVERLESS"),
    (dict(avg_queue_s=6.0), "PERFORMANCE", "RESIZE MEDIUM -> LARGE"),
    (dict(spill_gb=11.0), "PERFORMANCE", "RESIZE MEDIUM -> LARGE"),
    (dict(peak_concurrent=21), "CONCURRENCY",
     "RAISE max_clusters 1 -> 3 (peak-cost may grow significantly)"),
    (dict(peak_concurrent=21, util_pct=30.0), "CONCURRENCY",
     "RAISE max_clusters 1 -> 3 (peak-cost may grow modestly)"),
    (dict(peak_concurrent=21, util_pct=None), "CONCURRENCY", "RAISE max_clusters 1 -> 3"),
    (dict(max_clusters=4), "RIGHTSIZE", "CAP max_clusters 4 -> 1"),
    (dict(warehouse_type="PRO", util_pct=90.0, auto_stop_minutes=11), "HOUSEKEEPING",
     "AUTO-STOP 11m -> 10m"),
    (dict(warehouse_size="LARGE", p50_task_s=1.0, p95_task_s=2.0), "COST_REDUCE",
     "RESIZE LARGE -> MEDIUM"),
    (dict(warehouse_type="PRO", util_pct=1.0, hours_utilized=0.1, avg_queue_s=9.0,
          max_clusters=2, peak_concurrent=None, auto_stop_minutes=45), "COST_REDUCE",
     "MIGRATE PRO -> SERVERLESS + RESIZE MEDIUM -> LARGE + CAP max_clusters 2 -> 1"
     " + AUTO-STOP 45m -> 10m"),
])
def test_categories_and_actions(spark, changes, category, action):
    r = verdict(spark, **changes)
    assert (r["category"], r["recommended_action"]) == (category, action)
    assert r["selection_criteria"] == warehouses.WAREHOUSE_RULES[category]


def test_size_ladder_ends(spark):
    assert verdict(spark, warehouse_size="4X_LARGE", avg_queue_s=9.0)["rec_size"] == "4X_LARGE"
    light = dict(p50_task_s=1.0, p95_task_s=2.0)
    assert verdict(spark, warehouse_size="MEDIUM", **light)["rec_size"] == "MEDIUM"
    assert verdict(spark, warehouse_size="LARGE", spill_gb=0.01, **light)["rec_size"] == "LARGE"
    assert verdict(spark, warehouse_size="ODD", avg_queue_s=9.0)["rec_size"] == "ODD"


def test_clusters_are_clamped(spark):
    assert verdict(spark, peak_concurrent=5000)["rec_max_clusters"] == 30
    assert verdict(spark, peak_concurrent=None, max_clusters=7)["rec_max_clusters"] == 1
    assert verdict(spark, max_clusters=7, avg_queue_s=9.0)["rec_max_clusters"] == 7


def test_idle_managed_warehouse_saves_its_whole_cost(spark):
    r = verdict(spark, warehouse_type="CLASSIC", query_count=None, util_pct=None,
                hours_utilized=0.0, peak_concurrent=None)
    assert r["rec_type"] == "SERVERLESS" and r["cost_delta_pct"] == 95.0
    assert r["effective_savings_30d"] == r["current_cost_30d"] == 100.0


def test_small_saving_vanishes_instead_of_changing_category(spark):
    changes = dict(warehouse_type="CLASSIC", util_pct=10.0, hours_utilized=1.0, max_clusters=4)
    assert verdict(spark, dollars_30d=1.0, **changes)["category"] == "COST_REDUCE"
    assert reported(spark, dollars_30d=1.0, **changes) == 0
    assert reported(spark, dollars_30d=100.0, **changes) == 1


def test_unpriced_warehouse_keeps_only_findings_without_money(spark):
    assert reported(spark, dollars_30d=None, avg_queue_s=9.0) == 0
    assert reported(spark, dollars_30d=None, max_clusters=4) == 1
    assert verdict(spark, dollars_30d=None, query_count=None)["category"] != "DECOMMISSION_CANDIDATE"


def test_name_exclusion(spark):
    flagged = dict(max_clusters=4)
    assert reported(spark, warehouse_name="cleanup-auto-created-warehouse", **flagged) == 0
    assert reported(spark, warehouse_name=None, **flagged) == 0
    anything = replace(CFG, warehouse_exclude_name_pattern=None)
    assert reported(spark, anything, warehouse_name=None, **flagged) == 1


def test_multiplier_floor_and_unknown_rates(spark):
    r = verdict(spark, warehouse_type="CLASSIC", util_pct=0.0, hours_utilized=0.0)
    assert r["projected_cost_30d"] == 5.0
    r = verdict(spark, warehouse_type="ODD", warehouse_size="ODD")
    assert (r["category"], r["cost_delta_pct"]) == (None, 0.0)


def test_warehouse_report_order(spark):
    rows = [("COST_REDUCE", "a", 1.0, 9.0), ("DECOMMISSION_CANDIDATE", "b", 1.0, 0.0),
            ("DECOMMISSION_CANDIDATE", "c", 2.0, 0.0), ("COST_REDUCE", "d", 1.0, -20.0),
            ("HOUSEKEEPING", "e", None, None)]
    df = spark.createDataFrame(rows, "category string, warehouse_id string,"
                               " current_cost_30d double, projected_cost_delta_30d double")
    assert [r["warehouse_id"] for r in warehouses.in_report_order(df).collect()] == list("cbdae")


# queries and tables

HISTORY = ("statement_id string, executed_by string, warehouse_id string,"
           " start_time timestamp_ntz, end_time timestamp_ntz, total_task_duration_ms bigint,"
           " waiting_for_compute_duration_ms bigint, waiting_at_capacity_duration_ms bigint,"
           " read_bytes bigint, pruned_files_bytes bigint, spilled_local_bytes bigint,"
           " statement_type string, execution_status string, statement_text string")
NOON = datetime(2024, 1, 20, 12)
GB = 2 ** 30


def statement(i, text, ms=10_000, read=0, pruned=0, spilled=0, kind="SELECT",
              status="FINISHED", warehouse="w", user="u", start=NOON):
    return (f"q{i}", user, warehouse, start, start, ms, None, None, read, pruned, spilled,
            kind, status, text)


def findings(spark, rows, cfg=CFG):
    heavy = workloads.heavy_queries(spark.createDataFrame(rows, HISTORY), cfg=cfg)
    return workloads.signature_findings(workloads.signature_rollup(heavy, cfg=cfg), cfg=cfg)


def test_heavy_queries_floor_is_strict(spark):
    rows = [statement(1, "a", ms=5000), statement(2, "b", ms=5001), statement(3, None),
            statement(4, "c", kind="INSERT"), statement(5, "d", status="FAILED"),
            statement(6, "e", start=datetime(2023, 12, 31, 23))]
    df = workloads.heavy_queries(spark.createDataFrame(rows, HISTORY), cfg=CFG)
    assert [r["statement_id"] for r in df.collect()] == ["q2"]


def test_top_n_breaks_ties_by_signature(spark):
    rows = [statement(i, f"select {'x' * (i + 1)}") for i in range(5)]
    cfg = replace(CFG, top_expensive_queries_n=3)
    all_signatures = sorted(r[0] for r in findings(spark, rows, cfg).select("query_signature")
                            .distinct().collect())
    found = findings(spark, rows, cfg)
    top = workloads.expensive_queries(found, cfg=cfg)
    assert top.count() == 3
    samples = {r["query_sample"] for r in top.collect()}
    expected = {r["query_sample"] for r in found.where(
        F.col("query_signature").isin(all_signatures[:3])
        & (F.col("category") == workloads.EXPENSIVE)).collect()}
    assert samples == expected


def test_subset_detectors_use_only_their_subset(spark):
    rows = ([statement(i, "select a", read=2 * GB, pruned=0) for i in range(3)]
            + [statement(9, "select A", read=GB // 2, pruned=900 * GB)]
            + [statement(10 + i, "select b", spilled=2 * GB, ms=20_000) for i in range(3)]
            + [statement(19, "select b", spilled=0)])
    got = {r["category"]: r for r in
           workloads.threshold_queries(findings(spark, rows)).collect()}
    low = got[workloads.LOW_PRUNING]
    assert (low["exec_count"], low["pruning_pct"], low["total_read_gb"]) == (3, 0.0, 6.0)
    spill = got[workloads.HIGH_SPILL]
    assert (spill["exec_count"], spill["avg_spill_gb"], spill["avg_compute_s"]) == (3, 2.0, 20.0)
    assert workloads.REPEATED not in got


def test_unknown_pruning_is_not_low_pruning(spark):
    rows = [statement(i, "select a", read=2 * GB, pruned=None) for i in range(5)]
    assert workloads.threshold_queries(findings(spark, rows), workloads.LOW_PRUNING).count() == 0


def test_sample_is_the_least_text(spark):
    long = "select '" + "m" * 400 + "'"
    rows = [statement(1, long), statement(2, "select 'z'"), statement(3, "SELECT 'q'")]
    sample = workloads.expensive_queries(findings(spark, rows), cfg=CFG).first()["query_sample"]
    assert sample == min(long, "select 'z'", "SELECT 'q'")[:300]


def test_traffic_without_a_warehouse_has_no_target(spark):
    cfg = replace(CFG, subsecond_min_queries=1, subsecond_min_distinct_users=1,
                  subsecond_max_p50_s=99.0)
    history = spark.createDataFrame(
        [statement(1, "a", warehouse=None), statement(2, "a", warehouse="lost")], HISTORY)
    names = spark.createDataFrame(
        [("w", "n", datetime(2024, 1, 1))],
        "warehouse_id string, warehouse_name string, change_time timestamp_ntz")
    df = workloads.fast_bi_warehouses(
        workloads.finished_selects(history, cfg=cfg), names, cfg=cfg)
    assert {r["target"] for r in df.collect()} == {None, "warehouse: ? (lost)"}


# jobs

SIGNALS = ("workspace_id string, job_id string, job_name string, creator_id string,"
           " run_count_30d bigint, avg_run_minutes double, p50_run_minutes double,"
           " p95_run_minutes double, short_run_share_pct double, failed_runs bigint,"
           " infra_failure_count bigint, init_script_failure_count bigint,"
           " classic_dbus_30d double, serverless_dbus_30d double, classic_dbu_cost_30d double,"
           " startup_share double, p95_p50_ratio double, failure_rate_pct double,"
           " runs_per_day double")
JOB = dict(
    workspace_id="ws", job_id="j", job_name="job", creator_id="u", run_count_30d=20,
    avg_run_minutes=15.0, p50_run_minutes=10.0, p95_run_minutes=20.0, short_run_share_pct=50.0,
    failed_runs=0, infra_failure_count=1, init_script_failure_count=0, classic_dbus_30d=9.0,
    serverless_dbus_30d=0.0, classic_dbu_cost_30d=30.0, startup_share=0.25, p95_p50_ratio=2.0,
    failure_rate_pct=0.0, runs_per_day=2 / 3)


def job(spark, cfg=CFG, **changes):
    names = [c.split()[0] for c in SIGNALS.split(", ")]
    row = {**JOB, **changes}
    signals = spark.createDataFrame([tuple(row[n] for n in names)], SIGNALS)
    return jobs.assess_jobs(jobs.score_jobs(signals, cfg=cfg), cfg=cfg)


def test_perfect_job_scores_100(spark):
    r = job(spark).first()
    assert (r["fit_score"], r["fit_bucket"]) == (100, "80-100 (Strong)")
    assert r["top_reasons"] == (
        "short avg run (15.0 min); frequent (20 runs/30d); startup is 25% of wall-clock; "
        "consistent runtime (low p95/p50 spread); "
        "1 infra-flavored failure(s) serverless typically avoids")


def test_unsuitable_job_scores_0(spark):
    r = job(spark, avg_run_minutes=90.0, run_count_30d=3, startup_share=0.0, p95_p50_ratio=5.0,
            infra_failure_count=0).first()
    assert (r["fit_score"], r["pts_frequency"], r["top_reasons"]) == (3, 3.0, None)
    assert r["fit_bucket"] == "< 40 (Skip)"


def test_unknown_ratio_counts_as_predictable(spark):
    assert job(spark, p95_p50_ratio=None).first()["pts_predictability"] == 10.0


def test_blocker(spark):
    r = job(spark, init_script_failure_count=1).first()
    assert r["migration_risk"] == "BLOCKER"
    assert r["migration_checklist"].startswith("LIKELY BLOCKER")


def test_job_floors_and_exclusions(spark):
    assert job(spark, classic_dbu_cost_30d=24.99).count() == 0
    assert job(spark, run_count_30d=2).count() == 0
    kept = lambda cfg=CFG, **c: jobs.worth_reporting(job(spark, cfg, **c), cfg=cfg).count()
    assert kept() == 1
    assert kept(job_name="test-x") == kept(job_name=None) == 0
    assert kept(replace(CFG, jobs_exclude_name_pattern=None), job_name=None) == 1
    assert kept(replace(CFG, min_fit_score=101)) == 0


def test_prompt_needs_every_figure(spark):
    prompt = lambda **c: jobs.job_prompt(job(spark, **c), "Do:\n").first()["prompt_text"]
    text = prompt()
    assert text.startswith("Do:\nJob name: job\nAvg run duration: 15.0 min (p50 10.0, p95 20.0,"
                           " p95/p50 ratio 2.00)\n")
    assert "Classic DBU cost (30d): USD 30.00\nFit score: 100/100\n" in text
    assert prompt(job_name=None) is None and prompt(p95_p50_ratio=None) is None


# confidence and reports

def test_confidence(spark):
    wh = spark.createDataFrame(
        [("DECOMMISSION_CANDIDATE", None, None), ("RIGHTSIZE", None, None),
         ("COST_REDUCE", 55, -31.0), ("COST_REDUCE", 10 ** 6, 95.0)],
        "category string, query_count bigint, cost_delta_pct double")
    assert [r[-1] for r in warehouse_confidence(wh).collect()] == [95, 50, 71, 100]
    qt = spark.createDataFrame([(10, 600.0), (10 ** 6, 10.0 ** 9), (1, None)],
                               "exec_count bigint, total_compute_s double")
    assert [r[-1] for r in workload_confidence(qt).collect()] == [43, 100, 40]
    jb = spark.createDataFrame([(77,)], "fit_score int")
    assert job_confidence(jb).first()["confidence"] == 77
    labels = spark.createDataFrame([(80,), (79,), (60,), (59,)], "c int")
    assert [r[0] for r in labels.select(confidence_label(F.col("c"))).collect()] == [
        "High", "Medium", "Medium", "Low"]


def test_executive_filter_and_pick(spark):
    df = spark.createDataFrame([(50, None, "a"), (90, 10.0, "b"), (90, 1.0, "c")],
                               "confidence int, usd double, k string")
    names = lambda d: [r["k"] for r in d.collect()]
    assert names(executive_filter(df, cfg=CFG, savings="usd")) == ["a", "b", "c"]
    strict = replace(CFG, min_confidence=60, min_savings_30d=5.0)
    assert names(executive_filter(df, cfg=strict, savings="usd")) == ["b"]
    assert names(executive_filter(df, cfg=strict)) == ["b", "c"]
    assert names(pick(df, k=["a", "c"], confidence=None)) == ["a", "c"]


@pytest.fixture(scope="module")
def sets(spark):
    from checks.profiles import DEFAULT
    from checks.telemetry import telemetry
    return recommend(telemetry(spark, "/root/testdata/sf0.001"), cfg=DEFAULT).materialise()


def empty(sets):
    return [df.where("false") for _, df in sets.items()]


def test_set_invariants(sets):
    wh = sets.warehouse
    assert wh.where("utilization_pct < 0 OR utilization_pct > 100").count() == 0
    assert wh.where("projected_cost_30d < 0.05 * current_cost_30d - 0.01").count() == 0
    assert wh.count() == wh.select("warehouse_id").distinct().count() > 0
    assert sets.jobs.where("fit_score < 40 OR fit_score > 100").count() == 0
    assert sets.query_table.where("confidence < 40 OR confidence > 100").count() == 0


def test_reports_over_empty_sets(sets):
    nothing = empty(sets)
    kpis = exec_kpis(*nothing).first()
    assert (kpis["wh_count"], kpis["wh_savings_30d"], kpis["annualized"]) == (0, 0.0, 0.0)
    counters = overview(*nothing).first()
    assert (counters["wh_count"], counters["wh_savings"]) == (0, None)
    assert digest_payload(*nothing).first()["body"] == (
        "--- Top warehouse actions (confidence 0-100) ---\n\n"
        "--- Top query/table actions (confidence 0-100) ---\n\n"
        "--- Top job candidates (confidence = fit score 0-100) ---\n")
    assert "## " not in briefing_text(*nothing).first()["briefing"]


def test_reports_over_a_part_of_the_sets(sets):
    kpis = exec_kpis(None, None, sets.jobs).first()
    assert (kpis["wh_count"], kpis["qt_compute_hours"]) == (0, 0.0) and kpis["jb_count"] > 0
    assert set(overview(sets.warehouse, None, None).columns) == {"wh_count", "wh_savings", "wh_current"}
    body = digest_payload(sets.warehouse, None, None).first()["body"]
    assert "Warehouses flagged" in body and "serverless candidates" not in body
    text = briefing_text(None, sets.query_table, None).first()["briefing"]
    assert text.count("## ") == 1 and "## Query/table optimizations" in text
    with pytest.raises(ValueError):
        exec_kpis(None, None, None)


def test_a_briefing_has_all_columns_of_its_sets(sets):
    for place, (_, df) in enumerate(sets.items()):
        parts = [None, None, None]
        parts[place] = df
        text = briefing_text(*parts).first()["briefing"]
        assert f"| {' | '.join(df.columns)} |" in text


def test_table_cells_stay_cells(sets):
    odd = sets.warehouse.withColumn("warehouse_name", F.lit("a|b\nc"))
    text = briefing_text(odd, None, None).first()["briefing"]
    assert "| a\\|b c |" in text


def test_actions_rank_and_cover_all_sets(sets):
    actions = consolidated_actions(sets.warehouse, sets.query_table, sets.jobs)
    assert actions.count() == sum(df.count() for _, df in sets.items())
    impact = [r["impact_usd_30d"] for r in top_actions(actions, 20).collect()]
    assert len(impact) == 20 and impact == sorted(impact, reverse=True)
    only_jobs = consolidated_actions(None, None, sets.jobs)
    assert {r[0] for r in only_jobs.select("source").distinct().collect()} == {"jobs"}
    with pytest.raises(ValueError):
        consolidated_actions(None, None, None)


def test_write_and_read_back(spark, sets, tmp_path):
    sets.write_parquet(str(tmp_path))
    for name, df in sets.items():
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.columns == df.columns and back.count() == df.count()


def test_selection(spark, sets):
    with pytest.raises(ValueError, match="query_table"):
        recommend(Telemetry(), cfg=CFG, selected=["warehouse", "quux"])
    with pytest.raises(ValueError, match="job_runs"):
        recommend(Telemetry(), cfg=CFG, selected=["jobs"])
    assert recommend(Telemetry(), cfg=CFG, selected=[]).items() == []


def test_thresholds_are_checked():
    with pytest.raises(ValueError, match="queries_per_cluster_target"):
        Thresholds(queries_per_cluster_target=0)
    from datetime import timedelta, timezone
    cfg = Thresholds(as_of=datetime(2024, 1, 1, 2, tzinfo=timezone(timedelta(hours=2))))
    assert cfg.as_of == datetime(2024, 1, 1) and cfg.window_start == datetime(2023, 12, 2)
