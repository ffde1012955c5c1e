"""Relation-level helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed before later filters apply.

    Catalyst pushes a filter below a projection by writing out the columns it
    names in terms of their inputs. After several dependent projections that
    text grows beyond what can be compiled. Filters are not pushed through a
    generator, so this keeps them on the finished columns. Meant for reduced
    rows, where computing a column that is then filtered out costs nothing.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` behind one shuffle of whole rows, so that all reads of it in a plan
    share that shuffle and compute it once. The keys stay outside of the generator,
    so that sums, windows and joins by them need no further shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return settle(df.repartition(*keys))
    return df.repartition(*keys).select(*keys, F.inline(F.array(F.struct(*others)))).select(*df.columns)


def ranked(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """``df`` in total order.

    A total sort first samples its input to find range borders, which computes
    the input twice. Shuffling the few finished rows by ``keys`` beforehand lets
    both passes read that shuffle instead.
    """
    return df.repartition(*keys).orderBy(*order)
