"""Text assembly and query fingerprinting as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a fingerprint blanks out, applied in this order to the
# lower-cased statement.
FINGERPRINT_RULES = (
    (r"'[^']*'", "?"),   # string literals
    (r"\b\d+\b", "?"),   # whole numbers
    (r"\s+", " "),       # runs of white space
)


def fingerprint(statement: Column) -> Column:
    """MD5 of the statement with its literals blanked, over the whole text."""
    shape = F.lower(statement)
    for pattern, replacement in FINGERPRINT_RULES:
        shape = F.regexp_replace(shape, pattern, replacement)
    return F.md5(shape)


def join_parts(separator: str, *parts: Column) -> Column:
    """Join the parts that apply; NULL when none does."""
    return F.nullif(F.concat_ws(separator, *parts), F.lit(""))


def rule_ladder(rules: Sequence[tuple[Column, object]]) -> Column:
    """First matching rule wins; NULL when no rule matches."""
    first, *rest = rules
    ladder = F.when(first[0], first[1])
    for condition, outcome in rest:
        ladder = ladder.when(condition, outcome)
    return ladder
