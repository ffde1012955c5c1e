"""Pricing of billed usage through validity-interval list prices.

Quantities, prices and their sums are decimals throughout, so amounts don't depend on the order in
which partial sums meet; they are rounded once, where they are reported. A quantity has 11 digits before
the point and a price 8, so a product fits into ``AMOUNT``; what doesn't fit fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import AMOUNT, exact, instant
from tellwise.sources.contracts import QUANTITY
from tellwise.sources.scans import job_usage, prices_in, warehouse_usage


def priced_usage(usage: DataFrame, prices: DataFrame, *, cfg: Thresholds,
                 currency: str = "USD") -> DataFrame:
    """Usage rows with the list price valid when the usage ended.

    Both ends of a validity row are inclusive, so an instant on two rows is
    priced twice; usage without a price in ``currency`` drops out.

    No join hint is given. The price list is broadcast when its size estimate,
    or the size measured at run time, is under Spark's broadcast threshold;
    beyond it Spark sorts and merges on (sku, unit) and splits hot SKUs.
    """
    valid_until = F.coalesce(
        F.col("price_end_time"), instant(prices, "price_start_time", cfg.open_price_end))
    card = prices_in(prices, currency).select(
        F.col("sku_name").alias("_sku"), F.col("usage_unit").alias("_unit"),
        F.col("price_start_time").alias("_from"), valid_until.alias("_until"),
        "list_price")
    matches = ((F.col("sku_name") == F.col("_sku"))
               & (F.col("usage_unit") == F.col("_unit"))
               & F.col("usage_end_time").between(F.col("_from"), F.col("_until")))
    return usage.join(card, matches).drop("_sku", "_unit", "_from", "_until")


def by_price(billed: DataFrame, prices: DataFrame, *keys: str, cfg: Thresholds) -> DataFrame:
    """Usage summed by key, SKU and list price, which is all that an amount depends on. The price
    list is short next to the usage, so the rows are summed where they were read and only these
    few sums move; quantities are multiplied once, by their sum, which is exact."""
    return priced_usage(billed, prices, cfg=cfg).groupBy(*keys, "sku_name", "list_price").agg(
        exact(F.sum("usage_quantity"), QUANTITY).alias("usage_quantity"))


def _amount() -> Column:
    return (F.col("usage_quantity") * F.col("list_price")).cast(AMOUNT)


def warehouse_cost(usage: DataFrame, prices: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Units and list dollars per warehouse inside the window."""
    billed = by_price(warehouse_usage(usage, cfg=cfg), prices, "warehouse_id", cfg=cfg)
    return billed.groupBy("warehouse_id").agg(
        F.sum("usage_quantity").alias("dbus_30d"),
        F.sum(_amount()).alias("dollars_30d"))


def job_billing(usage: DataFrame, prices: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Classic and serverless units, and classic list dollars, per job."""
    billed = by_price(job_usage(usage, cfg=cfg), prices, "workspace_id", "job_id", cfg=cfg)
    quantity = F.col("usage_quantity")
    serverless = F.col("sku_name").ilike("%SERVERLESS%")
    zero = F.lit(0).cast(QUANTITY)
    return billed.groupBy("workspace_id", "job_id").agg(
        F.sum(F.when(serverless, zero).otherwise(quantity)).alias("classic_dbus_30d"),
        F.sum(F.when(serverless, quantity).otherwise(zero)).alias("serverless_dbus_30d"),
        F.sum(F.when(serverless, F.lit(0).cast(AMOUNT)).otherwise(_amount()))
         .alias("classic_dbu_cost_30d"))
