"""Column builders shared by the operators; all of them stay JVM-side."""

from tellwise.functions.frames import once, ranked, settle
from tellwise.functions.numeric import (
    AMOUNT, cents, cents_text, decimal_text, exact, gigabytes, half_up, linear_score, lookup,
    nullif_zero,
)
from tellwise.functions.text import fingerprint, join_parts, rule_ladder
from tellwise.functions.timing import epoch_seconds, instant, since

__all__ = [
    "AMOUNT", "cents", "cents_text", "decimal_text", "epoch_seconds", "exact", "fingerprint", "gigabytes", "half_up",
    "instant", "join_parts", "linear_score", "lookup", "nullif_zero", "once", "ranked",
    "rule_ladder", "settle", "since",
]
