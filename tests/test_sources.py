"""Contracts, plan shapes and pushdown over Parquet telemetry."""

import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.profiles import DEFAULT
from checks.queries import registered
from checks.telemetry import telemetry
from tellwise import Telemetry, recommend
from tellwise.functions import since
from tellwise.operators.latest import current_warehouses
from tellwise.sources.scans import endpoint_queries
from tellwise.plans.warehouses import warehouse_base
from tellwise.plans.workloads import heavy_queries, signature_findings, signature_rollup
from tellwise.plans import workloads
from tellwise.sources.contracts import CONTRACTS, conform
from tellwise.sources.telemetry import SOURCES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The telemetry as Parquet tables, ids nested the way platforms log them."""
    root = tmp_path_factory.mktemp("telemetry")
    data = telemetry(spark, SF_DIR)
    nest = {
        "query_history": lambda d: d.withColumn("compute", F.struct("warehouse_id"))
                                    .drop("warehouse_id"),
        "usage": lambda d: d.withColumn("usage_metadata", F.struct("warehouse_id", "job_id"))
                            .withColumn("usage_quantity", F.col("usage_quantity").cast("decimal(38,18)"))
                            .drop("warehouse_id", "job_id"),
        "list_prices": lambda d: d.withColumn("pricing", F.struct(F.struct(
            F.col("list_price").cast("decimal(38,18)").alias("default")).alias("effective_list")))
                                  .drop("list_price"),
        "jobs": lambda d: d.withColumnRenamed("job_name", "name"),
    }
    paths = {}
    for name in SOURCES:
        paths[name] = str(root / name)
        nest.get(name, lambda d: d)(getattr(data, name)).write.parquet(paths[name])
    return Telemetry.from_parquet(spark, paths)


def test_contracts_cover_all_sources():
    assert set(CONTRACTS) == set(SOURCES)


def test_nested_and_flat_inputs_agree(spark, stored):
    flat = telemetry(spark, SF_DIR)
    for name in SOURCES:
        a, b = getattr(flat, name), getattr(stored, name)
        assert a.columns == b.columns
        if name == "usage":  # stored as decimals
            a, b = (df.withColumn("usage_quantity", F.round("usage_quantity", 12)) for df in (a, b))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_nested_inputs_give_the_same_findings(spark, stored):
    for name, ours in recommend(stored, cfg=DEFAULT).items():
        theirs = dict(recommend(telemetry(spark, SF_DIR), cfg=DEFAULT).items())[name]
        assert ours.exceptAll(theirs).count() == theirs.exceptAll(ours).count() == 0


def test_contract_violations_are_named(spark):
    df = spark.createDataFrame([("w", "x", 1)], "warehouse_id string, event_time string, n int")
    with pytest.raises(ValueError, match="event_time is string.*cluster_count is missing"):
        conform(df, "warehouse_events")
    with pytest.raises(ValueError, match="unknown sources"):
        Telemetry.from_frames(nonsense=df)


def test_tables_by_name(spark, stored):
    stored.warehouses.createOrReplaceTempView("some_warehouses")
    data = Telemetry.from_tables(spark, {"warehouses": "some_warehouses"})
    assert data.warehouses.count() == stored.warehouses.count()


def test_ltz_timestamps_give_the_same_base(spark, stored):
    """Zoned timestamps holding the same UTC instants change nothing."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        zoned = {}
        for name in SOURCES:
            df = getattr(stored, name)
            zoned[name] = df.select(*[
                F.col(f.name).cast("timestamp") if f.dataType.simpleString() == "timestamp_ntz"
                else F.col(f.name) for f in df.schema.fields])
        a = warehouse_base(Telemetry(**zoned), cfg=DEFAULT)
        b = warehouse_base(stored, cfg=DEFAULT)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_shorter_window_drops_old_rows(stored):
    recent = replace(DEFAULT, lookback_days=7)
    first = endpoint_queries(stored.query_history, cfg=recent).agg(F.min("start_time")).first()[0]
    assert first >= datetime(2024, 1, 24)


# plan shapes

def test_window_bound_and_columns_reach_the_scan(stored):
    df = endpoint_queries(stored.query_history, cfg=DEFAULT).select("warehouse_id", "start_time")
    text = plan(df)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(start_time", text)
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "statement_text" not in schema and "compute:struct<warehouse_id:string>" in schema
    edges = stored.lineage.where(F.col("event_date") >= F.lit(DEFAULT.window_start_date))
    assert "GreaterThanOrEqual(event_date" in plan(edges)


def test_latest_limits_groups_before_the_shuffle(stored):
    text = plan(current_warehouses(stored.warehouses))
    before, after = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert before < text.index("Exchange") < after


def test_one_text_scan_feeds_all_signature_detectors(stored):
    heavy = heavy_queries(stored.query_history, cfg=DEFAULT)
    found = signature_findings(signature_rollup(heavy, cfg=DEFAULT), cfg=DEFAULT)
    both = workloads.expensive_queries(found, cfg=DEFAULT).unionByName(
        workloads.threshold_queries(found))
    both.collect()
    final = plan(both).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_statement_texts_are_scanned_once_for_all_detectors(stored):
    df = recommend(stored, cfg=DEFAULT, selected=["query_table"]).query_table
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert len(re.findall(r"FileScan[^\n]*statement_text#", final)) == 1
    joins = re.findall(r"ReusedExchange[^\n]*statement_id", final)
    assert len(joins) == 1


def test_facts_are_scanned_as_often_as_needed(stored):
    df = warehouse_base(stored, cfg=DEFAULT)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    # activity, statistics, and once more for spans that end before they start
    # (which the plan that ran leaves out where there are none)
    assert 2 <= len(re.findall(r"FileScan.*compute#", text)) <= 3
    assert 1 <= len(re.findall(r"FileScan.*cluster_count", text)) <= 2
    assert "ReusedExchange" in text
    assert len(re.findall(r"FileScan.*usage_quantity", text)) == 1


LAZY = sorted(registered())


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_rows_or_leaves_the_jvm(spark, name):
    text = plan(registered()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


def test_prices_beyond_the_broadcast_threshold_merge_instead(spark, stored):
    """Without any broadcast the results are the same."""
    build = lambda: warehouse_base(stored, cfg=DEFAULT)
    expected = sorted(build().collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = build()
        assert "BroadcastHashJoin" not in plan(df)
        assert sorted(df.collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_warehouse_with_most_rows_is_split(spark, stored):
    """One warehouse holding nearly everything still shuffles evenly."""
    hot = stored.query_history.withColumn("warehouse_id", F.lit("wh-0"))
    df = endpoint_queries(hot, cfg=DEFAULT).groupBy("warehouse_id", "total_task_duration_ms") \
        .agg(F.count(F.lit(1)).alias("n"))
    sizes = [r[0] for r in df.repartition(4, "warehouse_id", "total_task_duration_ms")
             .groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 0.5 * sum(sizes)


def test_since_keeps_the_column_type(spark):
    df = spark.range(1).select(F.timestamp_seconds(F.lit(1_706_659_200)).alias("t"))
    assert since(df, "t", datetime(2024, 1, 31)).count() == 1
    assert since(df, "t", datetime(2024, 1, 31, 0, 0, 1)).count() == 0
