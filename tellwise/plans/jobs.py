"""Scoring of scheduled jobs for a move to serverless compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import (
    cents, decimal_text, half_up, join_parts, linear_score, nullif_zero, ranked, rule_ladder, settle,
)
from tellwise.operators.latest import current_jobs
from tellwise.operators.pricing import job_billing
from tellwise.operators.stats import run_stats
from tellwise.plans.labels import (
    CHECKLIST_BLOCKER, CHECKLIST_GENERIC, FIT_BUCKET_REST, FIT_BUCKETS,
)
from tellwise.sources.telemetry import Telemetry

JOB_KEY = ["workspace_id", "job_id"]
# Points per signal, cap of the startup share, days behind a rate.
POINTS = {"duration": 30, "frequency": 20, "startup": 20, "predictability": 10,
          "infra_failures": 20}
MAX_STARTUP_SHARE = 0.80
RATE_DAYS = 30.0

COLUMNS = (
    "job_id", "job_name", "workspace_id", "creator_id", "fit_score", "fit_bucket",
    "run_count_30d", "runs_per_day", "avg_run_minutes", "p50_run_minutes",
    "p95_run_minutes", "p95_p50_ratio", "short_run_share_pct", "startup_share_pct",
    "failure_rate_pct", "infra_failure_count", "init_script_failure_count",
    "classic_dbus_30d", "classic_dbu_cost_30d", "serverless_dbus_30d",
    "pts_duration", "pts_frequency", "pts_startup", "pts_predictability",
    "pts_infra_failures", "top_reasons", "migration_checklist", "migration_risk",
)


def job_signals(data: Telemetry, *, cfg: Thresholds) -> DataFrame:
    """Run, billing and derived signals per job that used classic compute."""
    jobs, runs, usage, prices = data.need("jobs", "job_runs", "usage", "list_prices")
    billing = job_billing(usage, prices, cfg=cfg).where("classic_dbus_30d > 0")
    run_count = F.col("run_count_30d")
    return (
        current_jobs(jobs).drop("change_time")
        .join(run_stats(runs, cfg=cfg), JOB_KEY)
        .join(billing, JOB_KEY)
        .withColumns({
            # LEAST skips the NULL of a zero average: such jobs are all startup
            "startup_share": F.least(
                F.lit(MAX_STARTUP_SHARE),
                F.lit(float(cfg.classic_startup_minutes))
                / nullif_zero(F.col("avg_run_minutes"))),
            "p95_p50_ratio":
                F.col("p95_run_minutes") / nullif_zero(F.col("p50_run_minutes")),
            "failure_rate_pct":
                F.lit(100.0) * F.col("failed_runs") / nullif_zero(run_count),
            "runs_per_day": run_count / F.lit(RATE_DAYS),
        }))


def score_jobs(signals: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Adds one ``score_*`` column per signal; together they reach 100."""
    def up_to(points: int, value: Column, full_at: float) -> Column:
        most = F.lit(float(points))
        return F.least(most, most * value / F.lit(float(full_at)))

    return signals.withColumns({
        "score_duration": linear_score(
            F.col("avg_run_minutes"), best=cfg.short_run_threshold_minutes,
            worst=cfg.long_run_threshold_minutes, points=POINTS["duration"]),
        "score_frequency": up_to(
            POINTS["frequency"], F.col("run_count_30d"), cfg.high_frequency_runs_30d),
        "score_startup": up_to(
            POINTS["startup"], F.col("startup_share") * F.lit(100.0),
            cfg.high_startup_share_pct),
        "score_predictability": linear_score(
            F.col("p95_p50_ratio"), best=cfg.predictable_p95_p50_ratio,
            worst=cfg.unpredictable_p95_p50_ratio, points=POINTS["predictability"]),
        "score_infra_failures":
            F.when(F.col("infra_failure_count") > 0, float(POINTS["infra_failures"]))
             .otherwise(0.0),
    })


def top_reasons(cfg: Thresholds) -> Column:
    """The signals that speak for the move, as one phrase each."""
    minutes, runs = F.col("avg_run_minutes"), F.col("run_count_30d")
    startup_pct = F.col("startup_share") * F.lit(100.0)
    infra = F.col("infra_failure_count")
    return join_parts(
        "; ",
        F.when(minutes <= cfg.short_run_threshold_minutes,
               F.concat(F.lit("short avg run ("), decimal_text(minutes, 1), F.lit(" min)"))),
        F.when(runs >= cfg.high_frequency_runs_30d,
               F.concat(F.lit("frequent ("), runs, F.lit(" runs/30d)"))),
        F.when(startup_pct >= cfg.high_startup_share_pct,
               F.concat(F.lit("startup is "), decimal_text(startup_pct, 0),
                        F.lit("% of wall-clock"))),
        F.when(F.col("p95_p50_ratio") <= cfg.predictable_p95_p50_ratio,
               F.lit("consistent runtime (low p95/p50 spread)")),
        F.when(infra > 0,
               F.concat(infra, F.lit(" infra-flavored failure(s) serverless typically avoids"))))


def fit_bucket(score: Column) -> Column:
    ladder = rule_ladder([(score >= least, F.lit(label)) for least, label in FIT_BUCKETS])
    return ladder.otherwise(FIT_BUCKET_REST)


def assess_jobs(scored: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """The report columns for every job above the cost and run floors."""
    total = sum((F.col(f"score_{signal}") for signal in POINTS), F.lit(0.0))
    blocked = F.col("init_script_failure_count") > 0
    floors = ((F.col("classic_dbu_cost_30d") >= cfg.min_classic_dbu_cost_30d)
              & (F.col("run_count_30d") >= cfg.min_runs_30d))
    assessed = scored.where(floors).select(
        "job_id", "job_name", "workspace_id", "creator_id",
        half_up(total, 0).cast("int").alias("fit_score"),
        "run_count_30d",
        half_up(F.col("runs_per_day"), 1).alias("runs_per_day"),
        half_up(F.col("avg_run_minutes"), 1).alias("avg_run_minutes"),
        half_up(F.col("p50_run_minutes"), 1).alias("p50_run_minutes"),
        half_up(F.col("p95_run_minutes"), 1).alias("p95_run_minutes"),
        half_up(F.col("p95_p50_ratio"), 2).alias("p95_p50_ratio"),
        half_up(F.col("short_run_share_pct"), 1).alias("short_run_share_pct"),
        half_up(F.lit(100.0) * F.col("startup_share"), 1).alias("startup_share_pct"),
        half_up(F.col("failure_rate_pct"), 1).alias("failure_rate_pct"),
        "infra_failure_count", "init_script_failure_count",
        half_up(F.col("classic_dbus_30d"), 1).alias("classic_dbus_30d"),
        cents(F.col("classic_dbu_cost_30d")).alias("classic_dbu_cost_30d"),
        half_up(F.col("serverless_dbus_30d"), 1).alias("serverless_dbus_30d"),
        *[half_up(F.col(f"score_{s}"), 0).alias(f"pts_{s}") for s in POINTS],
        top_reasons(cfg).alias("top_reasons"),
        F.when(blocked, CHECKLIST_BLOCKER).otherwise(CHECKLIST_GENERIC)
         .alias("migration_checklist"),
        F.when(blocked, "BLOCKER").otherwise("OK").alias("migration_risk"),
    ).withColumn("fit_bucket", fit_bucket(F.col("fit_score")))
    return settle(assessed.select(*COLUMNS))


def worth_reporting(assessed: DataFrame, *, cfg: Thresholds) -> DataFrame:
    kept = assessed.where(F.col("fit_score") >= cfg.min_fit_score)
    if cfg.jobs_exclude_name_pattern is not None:
        kept = kept.where(~F.col("job_name").rlike(cfg.jobs_exclude_name_pattern))
    return kept


def in_report_order(findings: DataFrame) -> DataFrame:
    return ranked(
        findings, JOB_KEY, F.col("fit_score").desc(), F.col("classic_dbu_cost_30d").desc_nulls_last(), *JOB_KEY)


def recommend_jobs(data: Telemetry, *, cfg: Thresholds) -> DataFrame:
    scored = score_jobs(job_signals(data, cfg=cfg), cfg=cfg)
    return worth_reporting(assess_jobs(scored, cfg=cfg), cfg=cfg)


def job_prompt(findings: DataFrame, instructions: str = "") -> DataFrame:
    """Adds ``prompt_text``: the job's signals in words, after ``instructions``.

    The text is data for whoever writes a justification; no model is called. A
    NULL name or figure makes the whole text NULL.
    """
    def fixed(column: str, digits: int) -> Column:
        return decimal_text(F.col(column), digits)

    # Wording and order of the signal lines.
    lines = [
        ["Job name: ", F.col("job_name")],
        ["Avg run duration: ", fixed("avg_run_minutes", 1), " min (p50 ",
         fixed("p50_run_minutes", 1), ", p95 ", fixed("p95_run_minutes", 1),
         ", p95/p50 ratio ", fixed("p95_p50_ratio", 2), ")"],
        ["Run frequency: ", F.col("run_count_30d"), " runs in 30 days (",
         fixed("runs_per_day", 1), "/day)"],
        ["Estimated startup overhead: ~", fixed("startup_share_pct", 1),
         "% of wall-clock per run"],
        ["Failure rate: ", fixed("failure_rate_pct", 1), "% (",
         F.col("infra_failure_count"),
         " infra-flavored failures: cluster/driver errors)"],
        ["Init-script failures: ", F.col("init_script_failure_count"),
         " (any > 0 may indicate a migration blocker)"],
        ["Classic DBU cost (30d): USD ", fixed("classic_dbu_cost_30d", 2)],
        ["Fit score: ", F.col("fit_score"), "/100"],
        ["Detected signals: ", F.coalesce("top_reasons", F.lit("none"))],
    ]
    parts: list[Column] = [F.lit(instructions)]
    for i, line in enumerate(lines):
        if i:
            parts.append(F.lit("\n"))
        parts += [F.lit(p) if isinstance(p, str) else p.cast("string") for p in line]
    return findings.withColumn("prompt_text", F.concat(*parts))
