"""Confidence scores (0-100) and the report filters that build on them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import half_up, rule_ladder
from tellwise.plans.labels import CONFIDENCE_LABELS, CONFIDENCE_REST

# Confidence in a deletion, and base, cap and divisor of the two
# signals that raise the confidence of the other findings.
DECOMMISSION_CONFIDENCE = 95
WAREHOUSE_BASE = 50.0
WAREHOUSE_QUERIES = (30.0, 10.0)
WAREHOUSE_DELTA = (20.0, 2.0)
WORKLOAD_BASE = 40.0
WORKLOAD_RUNS = (40.0, 5.0)
WORKLOAD_SECONDS = (20.0, 600.0)


def _signal(value: Column, cap_and_divisor: tuple[float, float]) -> Column:
    cap, divisor = cap_and_divisor
    return F.least(F.lit(cap), F.coalesce(value, F.lit(0)) / F.lit(divisor))


def _score(*terms: Column) -> Column:
    total = sum(terms[1:], terms[0])
    return F.least(F.lit(100.0), half_up(total, 0)).cast("int")


def warehouse_confidence(findings: DataFrame) -> DataFrame:
    score = _score(F.lit(WAREHOUSE_BASE),
                   _signal(F.col("query_count"), WAREHOUSE_QUERIES),
                   _signal(F.abs("cost_delta_pct"), WAREHOUSE_DELTA))
    deletion = F.col("category") == "DECOMMISSION_CANDIDATE"
    return findings.withColumn(
        "confidence", F.when(deletion, DECOMMISSION_CONFIDENCE).otherwise(score))


def workload_confidence(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", _score(
        F.lit(WORKLOAD_BASE),
        _signal(F.col("exec_count"), WORKLOAD_RUNS),
        _signal(F.col("total_compute_s"), WORKLOAD_SECONDS)))


def job_confidence(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", F.col("fit_score").cast("int"))


def confidence_label(score: Column) -> Column:
    ladder = rule_ladder([(score >= least, F.lit(label)) for least, label in CONFIDENCE_LABELS])
    return ladder.otherwise(CONFIDENCE_REST)


def executive_filter(findings: DataFrame, *, cfg: Thresholds,
                     savings: str | None = None) -> DataFrame:
    """Drop findings below the confidence floor and, given a column, the dollar floor."""
    kept = findings.where(F.col("confidence") >= cfg.min_confidence)
    if savings is not None:
        kept = kept.where(F.coalesce(savings, F.lit(0.0)) >= cfg.min_savings_30d)
    return kept


def pick(findings: DataFrame, **wanted: Collection[str] | None) -> DataFrame:
    """Keep rows whose column value is among the wanted ones; None keeps all."""
    for column, values in wanted.items():
        if values is not None:
            findings = findings.where(F.col(column).isin(*values))
    return findings
