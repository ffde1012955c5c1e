"""Exact discrete percentiles from value counts, by rank selection over blocks of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellwise.functions import once

#: Blocks per doubling of the value: values of a block lie within about 2 %.
BLOCKS_PER_DOUBLING = 32


def value_block(value: Column) -> Column:
    """A number that never falls as the value rises; some 2,000 for all 64-bit numbers of a sign."""
    steps = F.floor(F.log2(F.abs(value.cast("double")) + 1) * BLOCKS_PER_DOUBLING)
    return F.when(value < 0, -steps).otherwise(steps)


def summarise(histogram: DataFrame, keys: Sequence[str], *, value: str, weight: str,
              percents: Mapping[str, int], sums: Mapping[str, Column]) -> DataFrame:
    """One row per key: the named percentiles of ``value`` and the named ``sums``.

    ``histogram`` holds one row per (key, value) with the number of occurrences in
    ``weight``; NULL values count in the sums but have no rank. The percentile is
    the least value that at least that share of the occurrences do not exceed.

    Counting per (key, value) combines map-side and spreads a busy key over all
    tasks. The counts are then dealt by (key, block of values) in one shuffle that
    is read twice: for sums by block, of which a key has a few hundred and which
    tell the block that holds each rank; and for those blocks alone, in which the
    value of the rank is found by running sums. So no task holds the distinct
    values of a key, and no window runs over more than one block of them.
    """
    block = "_block"
    occurrences = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(F.lit(0))
    dealt = once(
        histogram.select(*keys, value_block(F.col(value)).alias(block), F.col(value).alias("_value"),
                         occurrences.alias("_n"), *[s.alias(name) for name, s in sums.items()]),
        *keys, block)
    by_block = dealt.groupBy(*keys, block).agg(F.sum("_n").alias("_n"), *[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_block.withColumns({
        "_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "_of": F.sum("_n").over(whole),
        "_place": F.row_number().over(whole.orderBy(block)),
        **{s: F.sum(s).over(whole) for s in sums}})
    holds = [(F.col("_before") * 100 < F.col("_of") * p) & ((F.col("_before") + F.col("_n")) * 100 >= F.col("_of") * p)
             for p in percents.values()]
    # A key without any value keeps a row for its sums.
    wanted = placed.where(reduce(Column.__or__, holds, (F.col("_of") == 0) & (F.col("_place") == 1)))
    wanted = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(block).alias("_of_block"), "_before", "_of", *sums)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col(block).eqNullSafe(F.col("_of_block")))
    found = dealt.drop(*sums).join(wanted, same)
    inside = Window.partitionBy(*keys, block).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_n").over(inside)
    marks = [F.min(F.when((F.col("_upto") * 100 >= F.col("_of") * p) & (F.col("_of") > 0), F.col("_value"))).alias(name)
             for name, p in percents.items()]
    return found.withColumn("_upto", upto).groupBy(*keys).agg(*[F.first(s).alias(s) for s in sums], *marks)
