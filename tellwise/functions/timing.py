"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, fraction dropped.

    Zone-less timestamps are read as UTC.
    """
    return F.unix_timestamp(ts)


def instant(df: DataFrame, column: str, at: datetime) -> Column:
    """``at`` (naive UTC) as a literal of the same type as ``df[column]``.

    Matching the type keeps comparisons free of casts, so the bound reaches the
    scan as a pushed filter.
    """
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    micros = round(at.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def since(df: DataFrame, column: str, start: datetime) -> DataFrame:
    """Rows whose ``column`` is at or after ``start``; NULLs are dropped."""
    return df.where(F.col(column) >= instant(df, column, start))
