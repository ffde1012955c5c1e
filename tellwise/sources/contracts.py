"""Input contracts: which columns each telemetry source must offer.

A source may deliver a field nested (as platforms usually log it) or already
flat. ``conform`` projects either form onto the flat contract, so everything
downstream sees one shape and the scan reads only contract columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellwise.functions import exact

_FAMILIES: dict[str, tuple[type[T.DataType], ...]] = {
    "text": (T.StringType, T.IntegralType),
    "whole": (T.IntegralType,),
    "quantity": (T.NumericType,),
    "price": (T.NumericType,),
    "time": (T.TimestampType, T.TimestampNTZType),
    "day": (T.DateType,),
}
# "time" and "day" keep the delivered type, so range filters stay pushable.
# Quantities and prices are exact numbers of nine decimals, so that sums of their products are exact
# as well and fit into 38 digits (see operators.pricing).
QUANTITY, PRICE = "decimal(20,9)", "decimal(17,9)"
_TARGET = {"text": "string", "whole": "bigint", "quantity": QUANTITY, "price": PRICE}


@dataclass(frozen=True)
class Field:
    name: str
    family: str
    nested: str | None = None


def _fields(**families: str) -> tuple[Field, ...]:
    return tuple(Field(n, *spec.split("@")) for n, spec in families.items())


CONTRACTS: dict[str, tuple[Field, ...]] = {
    "warehouses": _fields(
        warehouse_id="text", warehouse_name="text", warehouse_size="text",
        warehouse_type="text", auto_stop_minutes="whole", min_clusters="whole",
        max_clusters="whole", change_time="time",
    ),
    "warehouse_events": _fields(
        warehouse_id="text", event_time="time", cluster_count="whole",
    ),
    "query_history": _fields(
        statement_id="text", executed_by="text",
        warehouse_id="text@compute.warehouse_id",
        start_time="time", end_time="time", total_task_duration_ms="whole",
        waiting_for_compute_duration_ms="whole",
        waiting_at_capacity_duration_ms="whole", read_bytes="whole",
        pruned_files_bytes="whole", spilled_local_bytes="whole",
        statement_type="text", execution_status="text", statement_text="text",
    ),
    "usage": _fields(
        billing_origin_product="text", workspace_id="text",
        warehouse_id="text@usage_metadata.warehouse_id",
        job_id="text@usage_metadata.job_id", sku_name="text", usage_unit="text",
        usage_quantity="quantity", usage_start_time="time", usage_end_time="time",
    ),
    "list_prices": _fields(
        sku_name="text", usage_unit="text", currency_code="text",
        price_start_time="time", price_end_time="time",
        list_price="price@pricing.effective_list.default",
    ),
    "jobs": _fields(
        workspace_id="text", job_id="text", job_name="text@name",
        creator_id="text", change_time="time",
    ),
    "job_runs": _fields(
        workspace_id="text", job_id="text", run_id="text",
        period_start_time="time", period_end_time="time",
        result_state="text", termination_code="text",
    ),
    "lineage": _fields(
        source_table_full_name="text", source_type="text", entity_id="text",
        created_by="text", event_date="day",
    ),
}


def _resolve(schema: T.StructType, path: str) -> T.DataType | None:
    found: T.DataType = schema
    for part in path.split("."):
        if not isinstance(found, T.StructType) or part not in found.names:
            return None
        found = found[part].dataType
    return found


def conform(df: DataFrame, source: str) -> DataFrame:
    """Project ``df`` onto the flat contract of ``source`` or raise ValueError."""
    columns: list[Column] = []
    problems: list[str] = []
    for field in CONTRACTS[source]:
        path, dtype = field.name, _resolve(df.schema, field.name)
        if dtype is None and field.nested:
            path, dtype = field.nested, _resolve(df.schema, field.nested)
        if dtype is None:
            problems.append(f"{field.name} is missing")
            continue
        if not isinstance(dtype, _FAMILIES[field.family]):
            problems.append(f"{path} is {dtype.simpleString()}, expected {field.family}")
            continue
        column = F.col(path)
        if _TARGET.get(field.family, "").startswith("decimal"):
            column = exact(column, _TARGET[field.family])
        elif field.family in _TARGET:
            column = column.cast(_TARGET[field.family])
        columns.append(column.alias(field.name))
    if problems:
        raise ValueError(f"source {source!r}: " + "; ".join(problems))
    return df.select(*columns)
