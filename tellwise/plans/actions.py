"""One ranked list of actions across the three recommendation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.functions import half_up
from tellwise.plans.labels import JOB_CATEGORY

SAMPLE_CHARS = 60
TOP_ACTIONS = 50


def _action(source: str, category: Column, target: Column, impact: Column,
            detail: Column) -> list[Column]:
    return [F.lit(source).alias("source"), category.alias("category"),
            target.alias("target"), half_up(impact, 2).alias("impact_usd_30d"),
            detail.alias("detail")]


def consolidated_actions(warehouses: DataFrame | None, workloads: DataFrame | None,
                         jobs: DataFrame | None) -> DataFrame:
    """Every finding as (source, category, target, impact_usd_30d, detail).

    Query and table findings carry no dollar figure and weigh zero.
    """
    parts = []
    if warehouses is not None:
        parts.append(warehouses.select(*_action(
            "warehouse", F.col("category"), F.col("warehouse_name"),
            F.col("effective_savings_30d"), F.col("recommended_action"))))
    if jobs is not None:
        detail = F.concat(F.lit("fit "), F.col("fit_score"), F.lit("/100 - "),
                          F.coalesce("top_reasons", F.lit("see migration_checklist")))
        parts.append(jobs.select(*_action(
            "jobs", F.lit(JOB_CATEGORY), F.col("job_name"),
            F.coalesce("classic_dbu_cost_30d", F.lit(0.0)), detail)))
    if workloads is not None:
        sample = F.concat(F.substring("query_sample", 1, SAMPLE_CHARS), F.lit("..."))
        parts.append(workloads.select(*_action(
            "query_table", F.col("category"), F.coalesce("target", sample),
            F.lit(0.0), F.col("recommended_action"))))
    if not parts:
        raise ValueError("no recommendation set was selected")
    return reduce(DataFrame.unionByName, parts)


def top_actions(actions: DataFrame, n: int = TOP_ACTIONS) -> DataFrame:
    """The n actions with the greatest impact; ties in text order."""
    return actions.orderBy(
        F.col("impact_usd_30d").desc_nulls_last(),
        "source", "category", "target", "detail").limit(n)
