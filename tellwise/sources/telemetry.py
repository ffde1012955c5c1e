"""The eight telemetry relations an analysis can draw on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tellwise.sources.contracts import CONTRACTS, conform


@dataclass(frozen=True)
class Telemetry:
    """Flat, contract-checked inputs. A source an analysis skips may be None."""

    warehouses: DataFrame | None = None
    warehouse_events: DataFrame | None = None
    query_history: DataFrame | None = None
    usage: DataFrame | None = None
    list_prices: DataFrame | None = None
    jobs: DataFrame | None = None
    job_runs: DataFrame | None = None
    lineage: DataFrame | None = None

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> "Telemetry":
        unknown = sorted(set(frames) - set(CONTRACTS))
        if unknown:
            raise ValueError(f"unknown sources {unknown}; valid: {sorted(CONTRACTS)}")
        return cls(**{name: conform(df, name) for name, df in frames.items()})

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: Mapping[str, str]) -> "Telemetry":
        """``tables`` maps a source name to a catalog table name."""
        return cls.from_frames(**{n: spark.table(t) for n, t in tables.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> "Telemetry":
        """``paths`` maps a source name to a Parquet path (file or directory)."""
        return cls.from_frames(**{n: spark.read.parquet(p) for n, p in paths.items()})

    def need(self, *names: str) -> list[DataFrame]:
        """The named sources, or ValueError listing those not provided."""
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"analysis needs sources {missing}")
        return [getattr(self, n) for n in names]


SOURCES = tuple(f.name for f in fields(Telemetry))
