"""Rounding, unit conversion and scoring as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Twelve decimals, so up to 10**26: what lies within half of 10**-12 below a rounding border
# counts as on it, which is far beyond what floating-point sums can tell.
_WIDE = "decimal(38,12)"
#: Sums of products of a quantity and a price.
AMOUNT = "decimal(38,18)"


def half_up(value: Column, digits: int) -> Column:
    """Round half up and return DOUBLE.

    The detour through a decimal makes the outcome independent of the order in
    which floating-point partial sums were merged.
    """
    return F.round(value.cast(_WIDE), digits).cast("double")


def exact(value: Column, kind: str) -> Column:
    """``value`` as the decimal type ``kind``; what doesn't fit fails the query. The cast is written
    once, as it is most of a row's work and each mention would be computed."""
    refused = F.raise_error(F.concat(F.lit("no number for " + kind + ": "), value.cast("string")))
    return F.coalesce(value.try_cast(kind), F.when(value.isNotNull(), refused.cast(kind)))


def cents(value: Column, digits: int = 2) -> Column:
    """An exact amount rounded half up, once, as DOUBLE."""
    return F.round(value.cast(AMOUNT), digits).cast("double")


def cents_text(value: Column, digits: int = 2) -> Column:
    """An exact amount rounded half up, once, as text with ``digits`` decimals."""
    return F.round(value.cast(AMOUNT), digits).cast(f"decimal(38,{digits})").cast("string")


def decimal_text(value: Column, digits: int) -> Column:
    """``value`` rounded half up, as text with exactly ``digits`` decimals."""
    return F.round(value.cast(_WIDE), digits).cast(f"decimal(38,{digits})").cast("string")


def nullif_zero(value: Column) -> Column:
    """Turn a zero divisor into NULL so that the division yields NULL."""
    return F.when(value != 0, value)


def gigabytes(num_bytes: Column) -> Column:
    return num_bytes.cast("double") / F.lit(float(1024 ** 3))


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of a small constant table; NULL for an unknown key."""
    if not table:
        return F.lit(None)
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.create_map(*entries)[key]


def linear_score(value: Column, *, best: float, worst: float, points: int) -> Column:
    """Full ``points`` at ``best`` or beyond, none at ``worst``, linear between.

    A NULL value scores full points: LEAST skips NULLs, so the upper clamp wins.
    A degenerate scale (``best == worst``) scores full points as well.
    """
    if best == worst:
        return F.lit(float(points))
    raw = F.lit(float(points)) * (F.lit(float(worst)) - value) / F.lit(float(worst - best))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(points)), raw))
