"""Threshold profiles of the registered queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from tellwise import Thresholds

AS_OF = datetime(2024, 1, 31)

# Name patterns match what the projected telemetry calls its throw-away objects;
# the BI limits suit its traffic, about a hundred statements per warehouse.
DEFAULT = Thresholds(
    as_of=AS_OF, warehouse_exclude_name_pattern="^tmp-",
    subsecond_min_queries=60, subsecond_max_p50_s=36.0, subsecond_min_distinct_users=2)

# No migrations and tighter cluster sizing: reaches every warehouse category.
TIGHT = replace(DEFAULT, migration_min_idle_pct=101.0, queries_per_cluster_target=1.0,
                size_down_max_p50_s=40.0, size_down_max_p95_s=200.0)

# A shorter window and active report filters.
RECENT = replace(DEFAULT, lookback_days=14, min_savings_30d=20.0, min_confidence=65,
                 mv_min_executions=10, jobs_exclude_name_pattern=None,
                 min_query_duration_s=20, min_fit_score=50)

# Idle warehouses are reported whatever they cost, also those without any billed usage.
ZERO_FLOOR = replace(DEFAULT, decommission_min_cost_30d=0.0)
