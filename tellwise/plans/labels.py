"""Categories, rule texts and fixed wording of the reports."""

from __future__ import annotations

# Warehouse categories in report order, each with its rule.
WAREHOUSE_RULES = {
    "DECOMMISSION_CANDIDATE":
        "query_count = 0 AND dollars_30d >= decommission_min_cost_30d",
    "COST_REDUCE":
        "cost_multiplier < 1.0 (rec_size smaller OR migrate to serverless saves >= 5%)"
        " AND |delta| >= min_delta_threshold",
    "PERFORMANCE":
        "cost_multiplier > 1.0 (size-up: spill_per_query > size_up_min_spill_gb_per_query"
        " OR avg_queue > size_up_min_avg_queue_s) AND |delta| >= min_delta_threshold",
    "CONCURRENCY":
        "CEIL(peak_concurrent / queries_per_cluster_target) > current max_clusters"
        " (target capped at max_cluster_ceiling)",
    "RIGHTSIZE":
        "CEIL(peak_concurrent / queries_per_cluster_target) < current max_clusters",
    "HOUSEKEEPING":
        "auto_stop_minutes > auto_stop_threshold_minutes AND warehouse_type IN"
        " (CLASSIC, PRO) AND no other action triggered",
}
MONEY_CATEGORIES = ("COST_REDUCE", "PERFORMANCE")

# Query and table categories in report order, each with its rule.
WORKLOAD_RULES = {
    "SUB_SECOND_BI_ENGINE_CANDIDATE":
        "per warehouse: COUNT(*) >= subsecond_min_queries AND p50 < subsecond_max_p50_s"
        " AND COUNT(DISTINCT executed_by) >= subsecond_min_distinct_users",
    "EXPENSIVE_QUERY_REVIEW":
        "top N query signatures by SUM(total_task_duration_ms)",
    "MATERIALIZED_VIEW_CANDIDATE":
        "same query signature: COUNT(*) >= mv_min_executions AND total compute >="
        " mv_min_total_compute_s",
    "LIQUID_CLUSTERING_CANDIDATE":
        "per-query read_bytes >= pruning_min_read_gb AND COUNT(*) >="
        " pruning_min_executions AND aggregate pruning% < pruning_max_pct",
    "HIGH_SPILL_QUERY":
        "per-row spilled_local_bytes > 0 AND COUNT(*) >= spill_min_executions AND"
        " AVG(spill GB) >= spill_min_avg_gb",
    "HOT_TABLE_REVIEW":
        "per source_table_full_name: COUNT(DISTINCT entity_id) >= hot_table_min_queries"
        " AND total compute >= hot_table_min_compute_s",
}

# Fit buckets with the least score of each, best first.
FIT_BUCKETS = (
    (80, "80-100 (Strong)"),
    (60, "60-79 (Good)"),
    (40, "40-59 (Marginal)"),
)
FIT_BUCKET_REST = "< 40 (Skip)"

# Confidence labels with the least score of each, best first.
CONFIDENCE_LABELS = ((80, "High"), (60, "Medium"))
CONFIDENCE_REST = "Low"

# The two migration checklists of a job.
CHECKLIST_BLOCKER = (
    "LIKELY BLOCKER: job uses init scripts (init script failures observed). "
    "Verify init script content can be replaced by serverless equivalents.")
CHECKLIST_GENERIC = (
    "Verify before migrating: (1) no init scripts / custom Docker, "
    "(2) no DBFS mounts the workload depends on, "
    "(3) supported Spark version, (4) no R, no GPU, "
    "(5) network access to required private endpoints.")

JOB_CATEGORY = "JOB_TO_SERVERLESS"

# Wording of the text payloads.
DIGEST_WAREHOUSES = ("Warehouses flagged: ", " | est 30d savings $",
                     "--- Top warehouse actions (confidence 0-100) ---")
DIGEST_WORKLOADS = ("Query/table optimizations: ", " compute hours",
                    "--- Top query/table actions (confidence 0-100) ---")
DIGEST_JOBS = ("Jobs->serverless candidates: ", " | addressable classic spend $",
               "--- Top job candidates (confidence = fit score 0-100) ---")
BRIEFING_HEAD = "Headline KPIs:\n"
BRIEFING_TITLES = ("Warehouse recommendations", "Query/table optimizations", "Jobs -> serverless")
BRIEFING_KPIS = (
    "- Identified warehouse savings (30d): $", "- Annualized projection: $",
    "- Warehouses flagged: ", " current 30d spend)",
    "- Query/table optimizations: ", " compute hours flagged)",
    "- Jobs -> serverless: ", " at >=70 fit, $", " addressable)",
)
