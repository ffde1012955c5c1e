"""Every tunable of the advisor in one immutable object.

Values are plain Python, so plans receive them as literals that Catalyst folds
and pushes to the scans.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from types import MappingProxyType

# Compute units per hour for each endpoint size, smallest first.
DBU_RATE = MappingProxyType({
    "2X_SMALL": 4.0,
    "X_SMALL": 6.0,
    "SMALL": 12.0,
    "MEDIUM": 24.0,
    "LARGE": 40.0,
    "X_LARGE": 80.0,
    "2X_LARGE": 144.0,
    "3X_LARGE": 272.0,
    "4X_LARGE": 528.0,
})

# Sizes from smallest to largest; one step up or down moves along this ladder.
SIZE_LADDER = tuple(DBU_RATE)

# List rate per compute unit for each endpoint type.
TYPE_RATE = MappingProxyType({"CLASSIC": 0.22, "PRO": 0.55, "SERVERLESS": 0.70})

# Names of throw-away objects that are never reported.
WAREHOUSE_EXCLUDE = "^(lakebridge-warehouse-[0-9]+|cleanup-auto-created-warehouse)$"
JOBS_EXCLUDE = "^(test-|dev-|scratch-)"


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Thresholds:
    """Rule thresholds, rate cards, report filters and the analysis instant.

    ``as_of`` is a naive UTC datetime. Pass it explicitly to make a report
    reproducible; left out, it is the moment the object is built.
    """

    as_of: datetime = field(default_factory=_utc_now)
    lookback_days: int = 30

    # queries and tables
    min_query_duration_s: int = 5
    top_expensive_queries_n: int = 20
    mv_min_executions: int = 20
    mv_min_total_compute_s: float = 300.0
    pruning_min_read_gb: float = 1.0
    pruning_max_pct: float = 20.0
    pruning_min_executions: int = 3
    spill_min_avg_gb: float = 1.0
    spill_min_executions: int = 3
    hot_table_min_queries: int = 50
    hot_table_min_compute_s: float = 100.0
    subsecond_min_queries: int = 5000
    subsecond_max_p50_s: float = 5.0
    subsecond_min_distinct_users: int = 3

    # scheduled jobs
    classic_startup_minutes: float = 5.0
    min_classic_dbu_cost_30d: float = 25.0
    min_runs_30d: int = 3
    short_run_threshold_minutes: float = 15.0
    long_run_threshold_minutes: float = 90.0
    high_frequency_runs_30d: int = 20
    high_startup_share_pct: float = 25.0
    predictable_p95_p50_ratio: float = 2.0
    unpredictable_p95_p50_ratio: float = 5.0
    min_fit_score: int = 40
    jobs_exclude_name_pattern: str | None = JOBS_EXCLUDE

    # warehouses
    dbu_rate: Mapping[str, float] = field(default_factory=lambda: DBU_RATE)
    type_rate: Mapping[str, float] = field(default_factory=lambda: TYPE_RATE)
    migration_min_idle_pct: float = 25.0
    migration_max_cost_ratio: float = 0.95
    size_up_min_spill_gb_per_query: float = 0.1
    size_up_min_avg_queue_s: float = 5.0
    size_down_max_p50_s: float = 30.0
    size_down_max_p95_s: float = 60.0
    size_down_max_avg_queue_s: float = 5.0
    size_down_min_queries: int = 10
    queries_per_cluster_target: float = 10.0
    max_cluster_ceiling: int = 30
    auto_stop_threshold_minutes: int = 10
    auto_stop_target_minutes: int = 10
    decommission_min_cost_30d: float = 5.0
    cost_multiplier_floor: float = 0.05
    raise_warn_high_util_pct: float = 80.0
    raise_warn_modest_util_pct: float = 30.0
    min_delta_threshold: float = 5.0
    warehouse_exclude_name_pattern: str | None = WAREHOUSE_EXCLUDE

    # report filters
    min_savings_30d: float = 0.0
    min_confidence: int = 0

    def __post_init__(self) -> None:
        for name in ("high_frequency_runs_30d", "high_startup_share_pct",
                     "queries_per_cluster_target", "lookback_days"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive, got {getattr(self, name)!r}")
        if self.as_of.tzinfo is not None:
            utc = self.as_of.astimezone(timezone.utc).replace(tzinfo=None)
            object.__setattr__(self, "as_of", utc)

    @property
    def window_start(self) -> datetime:
        """First instant inside the analysis window (inclusive)."""
        return self.as_of - timedelta(days=self.lookback_days)

    @property
    def window_start_date(self) -> date:
        """First calendar day inside the window, for day-grained sources."""
        return self.as_of.date() - timedelta(days=self.lookback_days)

    @property
    def open_price_end(self) -> datetime:
        """Stand-in end of a price row that is still valid."""
        return self.as_of + timedelta(days=1)
