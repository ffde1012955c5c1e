"""Cost and performance advisor for a data platform, written on PySpark."""

from tellwise.config import Thresholds
from tellwise.plans.advisor import Recommendations, recommend
from tellwise.sources.telemetry import Telemetry

__all__ = ["Recommendations", "Telemetry", "Thresholds", "recommend"]
