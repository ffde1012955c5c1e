"""Entry point: telemetry in, scored and filtered recommendation sets out."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tellwise.config import Thresholds
from tellwise.plans import jobs as job_plan
from tellwise.plans import warehouses as warehouse_plan
from tellwise.plans import workloads as workload_plan
from tellwise.plans.confidence import (
    executive_filter, job_confidence, warehouse_confidence, workload_confidence,
)
from tellwise.sources.folders import shared_folder
from tellwise.sources.telemetry import Telemetry

CHOICES = ("warehouse", "query_table", "jobs")


@dataclass(frozen=True)
class Recommendations:
    """The selected sets as lazy DataFrames; a set not selected is None."""

    warehouse: DataFrame | None = None
    query_table: DataFrame | None = None
    jobs: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(n, getattr(self, n)) for n in CHOICES if getattr(self, n) is not None]

    def ordered(self) -> "Recommendations":
        """The sets in report order."""
        sort = {"warehouse": warehouse_plan.in_report_order,
                "query_table": workload_plan.in_report_order,
                "jobs": job_plan.in_report_order}
        return replace(self, **{n: sort[n](df) for n, df in self.items()})

    def materialise(self) -> "Recommendations":
        """Compute each set once and keep it in the checkpoint folder.

        Worth it when several rollups read the sets, which are small next to the
        telemetry. The folder is shared storage, so lost executors lose nothing.
        """
        for _, df in self.items():
            use_checkpoint_folder(df.sparkSession)
        return replace(self, **{n: df.checkpoint() for n, df in self.items()})

    def write_parquet(self, folder: str, mode: str = "overwrite") -> None:
        """Write each set to ``folder/<name>``."""
        for name, df in self.items():
            df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Make the session's checkpoint folder effective, see ``shared_folder``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def check_selection(selected: Collection[str]) -> list[str]:
    unknown = [name for name in selected if name not in CHOICES]
    if unknown:
        raise ValueError(f"unknown recommendation sets {unknown}; valid: {list(CHOICES)}")
    return [name for name in CHOICES if name in selected]


def recommend(data: Telemetry, *, cfg: Thresholds | None = None,
              selected: Collection[str] = CHOICES,
              with_prompts: bool = False) -> Recommendations:
    """Run the selected analyses; nothing executes until a set is read.

    Each set carries a confidence score and honours the report filters of
    ``cfg``. ``with_prompts`` adds the per-job prompt text.
    """
    cfg = cfg or Thresholds()
    build = {
        "warehouse": lambda: executive_filter(
            warehouse_confidence(warehouse_plan.recommend_warehouses(data, cfg=cfg)),
            cfg=cfg, savings="effective_savings_30d"),
        "query_table": lambda: executive_filter(
            workload_confidence(workload_plan.recommend_workloads(data, cfg=cfg)), cfg=cfg),
        "jobs": lambda: executive_filter(
            job_confidence(job_plan.recommend_jobs(data, cfg=cfg)),
            cfg=cfg, savings="classic_dbu_cost_30d"),
    }
    sets = {name: build[name]() for name in check_selection(selected)}
    if with_prompts and "jobs" in sets:
        sets["jobs"] = job_plan.job_prompt(sets["jobs"])
    return Recommendations(**sets)
