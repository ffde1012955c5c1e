"""Latest version per key of a slowly changing dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order_by: str,
           ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the greatest ``order_by``.

    ``ties`` settle equal instants. Spark turns the rank filter into a
    per-partition group limit ahead of the shuffle, so a key with very many
    versions sends at most one row per map task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(
        F.col(order_by).desc(), *[F.col(c).desc() for c in ties])
    return (df.withColumn("_rank", F.row_number().over(newest_first))
              .where("_rank = 1").drop("_rank"))


def current_warehouses(warehouses: DataFrame) -> DataFrame:
    ties = [c for c in warehouses.columns if c not in ("warehouse_id", "change_time")]
    return latest(warehouses, ["warehouse_id"], "change_time", ties)


def current_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["workspace_id", "job_id"], "change_time",
                  ["job_name", "creator_id"])
