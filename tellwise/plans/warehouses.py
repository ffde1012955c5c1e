"""Right-sizing recommendations for SQL warehouses, one row per finding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.config import SIZE_LADDER, Thresholds
from tellwise.functions import (
    AMOUNT, cents, cents_text, half_up, join_parts, lookup, nullif_zero, ranked, rule_ladder, settle,
)
from tellwise.operators.intervals import activity
from tellwise.operators.latest import current_warehouses
from tellwise.operators.pricing import warehouse_cost
from tellwise.operators.stats import query_stats
from tellwise.plans.labels import MONEY_CATEGORIES, WAREHOUSE_RULES
from tellwise.sources.scans import endpoint_queries, state_log
from tellwise.sources.telemetry import Telemetry

SERVERLESS = "SERVERLESS"
MANAGED_TYPES = ("CLASSIC", "PRO")
# The least size that may be sized down.
LEAST_SIZE_DOWN = "LARGE"

COLUMNS = (
    "category", "selection_criteria", "recommended_action",
    "warehouse_id", "warehouse_name", "current_size", "rec_size",
    "current_type", "rec_type", "current_max_clusters", "rec_max_clusters",
    "auto_stop_minutes", "utilization_pct", "idle_hours_30d", "query_count",
    "p50_task_s", "p95_task_s", "avg_queue_s", "spill_gb", "peak_concurrent",
    "current_cost_30d", "projected_cost_30d", "projected_cost_delta_30d",
    "cost_delta_pct", "effective_savings_30d",
)


def warehouse_base(data: Telemetry, *, cfg: Thresholds) -> DataFrame:
    """One row per warehouse that has been on, with all measured signals.

    Every fact is reduced to one row per warehouse before the joins, and all
    reductions are partitioned by warehouse, so the joins add no shuffle.
    """
    warehouses, events, history, usage, prices = data.need(
        "warehouses", "warehouse_events", "query_history", "usage", "list_prices")
    queries = endpoint_queries(history, cfg=cfg)
    log = state_log(events, cfg=cfg)

    used = F.coalesce("util_s", F.lit(0))
    hours_on = F.col("on_s") / F.lit(3600.0)
    busy = F.lit(100.0) * used / nullif_zero(F.col("cluster_on_s"))
    return (
        current_warehouses(warehouses).drop("change_time")
        .join(activity(log, queries).where("on_s IS NOT NULL"), "warehouse_id")
        .join(query_stats(queries), "warehouse_id", "left")
        .join(warehouse_cost(usage, prices, cfg=cfg), "warehouse_id", "left")
        .withColumns({
            "hours_on": hours_on,
            "hours_utilized": used / F.lit(3600.0),
            "hours_idle": F.greatest(F.lit(0), F.col("on_s") - used) / F.lit(3600.0),
            "util_pct": F.when(
                F.coalesce("query_count", F.lit(0)) != 0,
                F.least(F.lit(100.0), half_up(busy, 1))),
        }))


def signals(cfg: Thresholds) -> dict[str, Column]:
    """Intermediate signals the rules share: need for power, used share."""
    spill_per_query = F.col("spill_gb") / nullif_zero(F.col("query_count"))
    grow = ((spill_per_query > cfg.size_up_min_spill_gb_per_query)
            | (F.col("avg_queue_s") > cfg.size_up_min_avg_queue_s))
    share = F.col("hours_utilized") / nullif_zero(F.col("hours_on"))
    return {"_grow": F.coalesce(grow, F.lit(False)),
            "_used_share": F.coalesce(share, F.lit(0.0))}


def recommended_type(cfg: Thresholds) -> Column:
    """SERVERLESS where a managed type idles enough for the move to pay off."""
    kind = F.col("warehouse_type")
    idle_pct = F.coalesce(F.lit(100.0) - F.col("util_pct"), F.lit(100.0))
    target = float(cfg.type_rate[SERVERLESS]) if SERVERLESS in cfg.type_rate else None
    # what a dollar on the current type costs on the target type
    dearer = {k: target / r for k, r in cfg.type_rate.items() if target is not None and r}
    pays_off = ((idle_pct > cfg.migration_min_idle_pct)
                & (lookup(dearer, kind) * F.col("_used_share") < cfg.migration_max_cost_ratio))
    return F.when(kind.isin(*MANAGED_TYPES) & pays_off, SERVERLESS).otherwise(kind)


def recommended_size(cfg: Thresholds) -> Column:
    """One step up under spill or queueing, one step down for light loads."""
    size = F.col("warehouse_size")
    bigger = dict(zip(SIZE_LADDER, SIZE_LADDER[1:]))
    shrinkable = SIZE_LADDER[SIZE_LADDER.index(LEAST_SIZE_DOWN):]
    smaller = {b: a for a, b in bigger.items() if b in shrinkable}
    light = ((F.col("p50_task_s") < cfg.size_down_max_p50_s)
             & (F.col("p95_task_s") < cfg.size_down_max_p95_s)
             & (F.col("avg_queue_s") < cfg.size_down_max_avg_queue_s)
             & (F.coalesce("spill_gb", F.lit(0.0)) == 0)
             & (F.col("query_count") >= cfg.size_down_min_queries))
    step = F.when(F.col("_grow"), lookup(bigger, size)).when(light, lookup(smaller, size))
    return F.coalesce(step, size)


def recommended_clusters(cfg: Thresholds) -> Column:
    peak = F.coalesce("peak_concurrent", F.lit(0))
    wanted = F.ceil(F.col("peak_concurrent") / F.lit(float(cfg.queries_per_cluster_target)))
    clamped = F.least(F.lit(cfg.max_cluster_ceiling).cast("bigint"),
                      F.greatest(F.lit(1).cast("bigint"), wanted))
    return (F.when(peak == 0, F.lit(1).cast("bigint"))
             .when(F.col("_grow"), F.col("max_clusters"))
             .otherwise(clamped))


def cost_multiplier(cfg: Thresholds) -> Column:
    """Projected over current cost; size, type and used share multiply."""
    def ratio(card: Mapping[str, float], new: str, old: str) -> Column:
        rates = {k: float(v) for k, v in card.items()}
        return F.coalesce(lookup(rates, F.col(new)) / nullif_zero(lookup(rates, F.col(old))),
                          F.lit(1.0))

    migrates = (F.col("rec_type") == SERVERLESS) & (F.col("warehouse_type") != SERVERLESS)
    share = F.when(migrates, F.col("_used_share")).otherwise(F.lit(1.0))
    return F.greatest(
        F.lit(float(cfg.cost_multiplier_floor)),
        ratio(cfg.dbu_rate, "rec_size", "warehouse_size")
        * ratio(cfg.type_rate, "rec_type", "warehouse_type") * share)


def conditions(cfg: Thresholds) -> dict[str, Column]:
    """Category -> its condition; the first that holds names the category."""
    return {
        "DECOMMISSION_CANDIDATE":
            (F.coalesce("query_count", F.lit(0)) == 0)
            & (F.coalesce("dollars_30d", F.lit(0.0)) >= cfg.decommission_min_cost_30d),
        "COST_REDUCE": F.col("cost_multiplier") < 1.0,
        "PERFORMANCE": F.col("cost_multiplier") > 1.0,
        "CONCURRENCY": F.col("rec_max_clusters") > F.col("max_clusters"),
        "RIGHTSIZE": F.col("rec_max_clusters") < F.col("max_clusters"),
        "HOUSEKEEPING":
            (F.col("auto_stop_minutes") > cfg.auto_stop_threshold_minutes)
            & F.col("warehouse_type").isin(*MANAGED_TYPES),
    }


def recommended_action(cfg: Thresholds) -> Column:
    """What to do, as text; every part that applies, whatever the category."""
    when = conditions(cfg)
    arrow = " -> "
    migrate = F.when(
        F.col("rec_type") != F.col("warehouse_type"),
        F.concat(F.lit("MIGRATE "), F.col("warehouse_type"), F.lit(arrow + SERVERLESS)))
    resize = F.when(
        F.col("rec_size") != F.col("warehouse_size"),
        F.concat(F.lit("RESIZE "), F.col("warehouse_size"), F.lit(arrow), F.col("rec_size")))
    busy = F.col("util_pct")
    warning = (
        F.when(busy >= cfg.raise_warn_high_util_pct, " (peak-cost may grow significantly)")
         .when(busy >= cfg.raise_warn_modest_util_pct, " (peak-cost may grow modestly)"))
    reclusters = F.concat_ws(
        "",
        rule_ladder([(when["CONCURRENCY"], F.lit("RAISE")), (when["RIGHTSIZE"], F.lit("CAP"))]),
        F.lit(" max_clusters "), F.col("max_clusters"), F.lit(arrow), F.col("rec_max_clusters"),
        F.when(when["CONCURRENCY"], warning))
    auto_stop = F.concat(F.lit("AUTO-STOP "), F.col("auto_stop_minutes"),
                         F.lit(f"m{arrow}{cfg.auto_stop_target_minutes}m"))
    delete = F.concat(F.lit("DELETE - 0 queries / 30d, $"),
                      cents_text(F.coalesce(F.col("dollars_30d").cast(AMOUNT), F.lit(0).cast(AMOUNT))), F.lit(" burned"))
    changes = join_parts(
        " + ", migrate, resize,
        F.when(F.col("rec_max_clusters") != F.col("max_clusters"), reclusters),
        F.when(when["HOUSEKEEPING"], auto_stop))
    return F.when(F.col("category") == "DECOMMISSION_CANDIDATE", delete).otherwise(changes)


def assess_warehouses(base: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Recommendations for every base row, before any is filtered out."""
    dollars, multiplier = F.col("dollars_30d"), F.col("cost_multiplier")
    cost, delta = F.col("current_cost_30d"), F.col("projected_cost_delta_30d")
    assessed = (
        base.withColumns(signals(cfg))
        .withColumns({
            "rec_type": recommended_type(cfg),
            "rec_size": recommended_size(cfg),
            "rec_max_clusters": recommended_clusters(cfg)})
        .withColumn("cost_multiplier", cost_multiplier(cfg))
        .withColumn("category",
                    rule_ladder([(c, F.lit(name)) for name, c in conditions(cfg).items()]))
        .select(
            "category",
            lookup(WAREHOUSE_RULES, F.col("category")).alias("selection_criteria"),
            recommended_action(cfg).alias("recommended_action"),
            "warehouse_id", "warehouse_name",
            F.col("warehouse_size").alias("current_size"), "rec_size",
            F.col("warehouse_type").alias("current_type"), "rec_type",
            F.col("max_clusters").alias("current_max_clusters"), "rec_max_clusters",
            "auto_stop_minutes",
            F.col("util_pct").alias("utilization_pct"),
            half_up(F.col("hours_idle"), 1).alias("idle_hours_30d"),
            "query_count",
            half_up(F.col("p50_task_s"), 1).alias("p50_task_s"),
            half_up(F.col("p95_task_s"), 1).alias("p95_task_s"),
            half_up(F.col("avg_queue_s"), 1).alias("avg_queue_s"),
            half_up(F.col("spill_gb"), 2).alias("spill_gb"),
            "peak_concurrent",
            cents(dollars).alias("current_cost_30d"),
            half_up(dollars * multiplier, 2).alias("projected_cost_30d"),
            half_up(dollars * (F.lit(1.0) - multiplier), 2).alias("projected_cost_delta_30d"),
            half_up(F.lit(100.0) * (F.lit(1.0) - multiplier), 1).alias("cost_delta_pct"))
        .withColumn(
            "effective_savings_30d",
            F.when(F.col("category") == "DECOMMISSION_CANDIDATE", cost)
             .otherwise(F.greatest(F.lit(0.0), delta)))
        .select(*COLUMNS))
    return settle(assessed)


def worth_reporting(assessed: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Findings with a category and an action; money findings also need a delta.

    An unpriced warehouse has no delta and so keeps only its other findings.
    """
    money = F.col("category").isin(*MONEY_CATEGORIES)
    material = F.abs("projected_cost_delta_30d") >= cfg.min_delta_threshold
    kept = assessed.where(
        F.col("category").isNotNull() & F.col("recommended_action").isNotNull()
        & (~money | material))
    if cfg.warehouse_exclude_name_pattern is not None:
        kept = kept.where(~F.col("warehouse_name").rlike(cfg.warehouse_exclude_name_pattern))
    return kept


def in_report_order(findings: DataFrame) -> DataFrame:
    rank = rule_ladder([(F.col("category") == name, F.lit(i))
                        for i, name in enumerate(WAREHOUSE_RULES)])
    size = F.when(F.col("category") == "DECOMMISSION_CANDIDATE", F.col("current_cost_30d")) \
            .otherwise(F.abs("projected_cost_delta_30d"))
    return ranked(findings, ["warehouse_id"], rank, size.desc_nulls_last(), "warehouse_id")


def recommend_warehouses(data: Telemetry, *, cfg: Thresholds) -> DataFrame:
    return worth_reporting(
        assess_warehouses(warehouse_base(data, cfg=cfg), cfg=cfg), cfg=cfg)
