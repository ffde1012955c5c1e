"""Operators on small hand-made or random rows, checked against plain Python."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellwise import Thresholds
from tellwise.functions import (
    cents, decimal_text, exact, fingerprint, half_up, join_parts, linear_score, lookup, since,
)
from tellwise.operators.intervals import (
    activity, on_time, overlap_seconds, peak_per_bucket, state_intervals,
)
from tellwise.operators.latest import latest
from tellwise.operators.pricing import priced_usage, warehouse_cost
from tellwise.operators.quantiles import summarise, value_block
from tellwise.operators.stats import query_stats, run_stats
from tellwise.operators.workload import table_reads, warehouse_traffic
from tellwise.sources.contracts import conform

T0 = datetime(2024, 1, 10)
CFG = Thresholds(as_of=datetime(2024, 1, 31))
STATES = "warehouse_id string, event_time timestamp_ntz, cluster_count bigint"
SPANS = "warehouse_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# functions

@pytest.mark.parametrize("x, digits, expected", [
    (0.285, 2, 0.29), (2.5, 0, 3.0), (-2.5, 0, -3.0), (1.005, 2, 1.01), (None, 1, None)])
def test_half_up(spark, x, digits, expected):
    assert value(spark, half_up(F.lit(x).cast("double"), digits)) == expected


def test_decimal_text_keeps_trailing_zeros(spark):
    assert value(spark, decimal_text(F.lit(12.5), 2)) == "12.50"
    assert value(spark, decimal_text(F.lit(1.0e8), 1)) == "100000000.0"


def test_linear_score(spark):
    def score(x):
        return value(spark, linear_score(F.lit(x).cast("double"), best=15, worst=90, points=30))
    assert [score(15.0), score(1.0), score(90.0), score(500.0)] == [30.0, 30.0, 0.0, 0.0]
    assert score(52.5) == 15.0
    assert score(None) == 30.0
    assert value(spark, linear_score(F.lit(9.0), best=2, worst=2, points=10)) == 10.0


def test_join_parts_and_lookup(spark):
    none = F.lit(None).cast("string")
    assert value(spark, join_parts(" + ", none, F.lit("a"), none, F.lit("b"))) == "a + b"
    assert value(spark, join_parts(" + ", none, none)) is None
    assert value(spark, lookup({"a": 1.0}, F.lit("a"))) == 1.0
    assert value(spark, lookup({"a": 1.0}, F.lit("z"))) is None
    assert value(spark, lookup({}, F.lit("a"))) is None


def test_fingerprint_blanks_literals(spark):
    def same(a, b):
        return value(spark, fingerprint(F.lit(a)) == fingerprint(F.lit(b)))
    assert same("SELECT a FROM t WHERE k = 17", "select a  from t\nwhere k = 9")
    assert same("select 'x''y' from t", "select 'other''q' from t")
    assert same("select 1.5", "select ?.?")
    assert not same("select col1", "select col2")
    assert value(spark, fingerprint(F.lit(None).cast("string"))) is None


def test_since_is_inclusive_and_drops_null(spark):
    rows = [("a", at(0), 1), ("b", at(-1), 1), ("c", None, 1)]
    kept = since(spark.createDataFrame(rows, STATES), "event_time", T0)
    assert [r[0] for r in kept.collect()] == ["a"]


# latest

def test_latest_breaks_ties(spark):
    rows = [("k", 1, "old"), ("k", 2, "b"), ("k", 2, "a"), ("m", 5, None)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = {r["k"]: r["v"] for r in latest(df, ["k"], "t", ["v"]).collect()}
    assert got == {"k": "b", "m": None}


# intervals

def lead_by_hand(rows):
    out, by_key = [], {}
    for k, t, s in rows:
        by_key.setdefault(k, []).append((t, s))
    for k, log in by_key.items():
        log.sort()
        for i, (t, s) in enumerate(log):
            out.append((k, t, log[i + 1][0] if i + 1 < len(log) else None, s))
    return out


def overlap_by_hand(rows, spans):
    util, on, cluster_on = {}, {}, {}
    floor = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() // 1)
    for k, a, b, s in lead_by_hand(rows):
        if b is None or not s or s <= 0:
            continue
        on[k] = on.get(k, 0) + floor(b) - floor(a)
        cluster_on[k] = cluster_on.get(k, 0) + (floor(b) - floor(a)) * s
        for q, qs, qe in spans:
            if q == k and qe is not None and qs < b and qe > a:
                util[k] = util.get(k, 0) + floor(min(qe, b)) - floor(max(qs, a))
    return util, on, cluster_on


def random_logs(seed, reversed_spans=False):
    rng = random.Random(seed)
    keys = ["a", "b", "c"]
    when = lambda: T0 + timedelta(microseconds=rng.choice(
        [rng.randrange(0, 4 * 3600 * 10 ** 6), rng.randrange(0, 3) * 10 ** 6,
         3_600_000_000, 3_600_000_000 + rng.randrange(0, 10 ** 6)]))
    rows = [(rng.choice(keys), when(), rng.choice([0, 0, 1, 2, 3])) for _ in range(60)]
    spans = []
    for _ in range(80):
        begun = when()
        ended = begun + timedelta(microseconds=rng.randrange(0, 2 * 3600 * 10 ** 6))
        if reversed_spans and rng.random() < 0.2:
            begun, ended = ended, begun
        spans.append((rng.choice(keys), begun, None if rng.random() < 0.1 else ended))
    return rows, spans


@pytest.mark.parametrize("seed, block_s", [(1, 3600), (2, 60), (3, 7)])
def test_state_intervals_match_a_plain_lead(spark, seed, block_s):
    rows, _ = random_logs(seed)
    got = state_intervals(spark.createDataFrame(rows, STATES), block_s=block_s).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(lead_by_hand(rows), key=key)


@pytest.mark.parametrize("seed, block_s", [(4, 60), (5, 600), (6, 3600), (7, 86400), (11, 120)])
def test_activity_matches_brute_force(spark, seed, block_s):
    rows, spans = random_logs(seed, reversed_spans=seed % 2 == 0)
    util, on, cluster_on = overlap_by_hand(rows, spans)
    got = {r["warehouse_id"]: r for r in activity(
        spark.createDataFrame(rows, STATES), spark.createDataFrame(spans, SPANS),
        block_s=block_s).collect()}
    for k in "abc":
        assert got[k]["on_s"] == on.get(k)
        assert got[k]["cluster_on_s"] == cluster_on.get(k)
        assert got[k]["util_s"] == util.get(k, 0)
        starts = [s[1].replace(second=0, microsecond=0) for s in spans if s[0] == k]
        assert got[k]["peak_concurrent"] == max(map(starts.count, starts))


@pytest.mark.parametrize("seed", range(8, 11))
def test_overlap_join_matches_brute_force_even_backwards(spark, seed):
    rows, spans = random_logs(seed, reversed_spans=True)
    util, _, _ = overlap_by_hand(rows, spans)
    got = overlap_seconds(spark.createDataFrame(rows, STATES),
                          spark.createDataFrame(spans, SPANS), method="join")
    assert {r[0]: r[1] for r in got.collect()} == util


def test_counts_beyond_32_bits_and_the_greater_of_two_at_one_instant(spark):
    rows = [("w", at(0), 2 ** 32), ("w", at(10), 0), ("w", at(10), 7), ("w", at(20), 0)]
    got = activity(spark.createDataFrame(rows, "warehouse_id string, event_time timestamp, cluster_count long"),
                   spark.createDataFrame([], SPANS)).first()
    assert (got["on_s"], got["cluster_on_s"]) == (20, 10 * 2 ** 32 + 70)


def test_a_block_holds_whole_minutes(spark):
    empty = spark.createDataFrame([], STATES), spark.createDataFrame([], SPANS)
    with pytest.raises(ValueError):
        activity(*empty, block_s=90)


def test_a_span_that_runs_backwards_counts_only_inside_one_interval(spark):
    rows = [("w", at(0), 1), ("w", at(100), 0), ("w", at(200), 1), ("w", at(300), 0)]
    spans = [("w", at(60), at(20)), ("w", at(250), at(50))]
    got = activity(spark.createDataFrame(rows, STATES), spark.createDataFrame(spans, SPANS)).first()
    assert got["util_s"] == -40


def test_open_and_stopped_states(spark):
    rows = [("open", at(0), 1),
            ("off", at(0), 0), ("off", at(50), 0),
            ("same", at(0), 1), ("same", at(0.5), 2),
            ("on", at(0), 2), ("on", at(100), 0), ("on", at(200), 1)]
    spans = [("idle", at(0), at(9)), ("on", at(-50), at(10)), ("on", at(100), at(150)),
             ("on", at(150), at(900))]
    got = {r["warehouse_id"]: r for r in activity(
        spark.createDataFrame(rows, STATES), spark.createDataFrame(spans, SPANS)).collect()}
    assert "open" not in got and "off" not in got
    assert got["same"]["on_s"] == 0
    assert got["idle"]["on_s"] is None and got["idle"]["peak_concurrent"] == 1
    assert (got["on"]["on_s"], got["on"]["cluster_on_s"], got["on"]["util_s"]) == (100, 200, 10)
    totals = {r[0]: tuple(r)[1:] for r in
              on_time(state_intervals(spark.createDataFrame(rows, STATES))).collect()}
    assert totals == {"same": (0, 0, 1), "on": (100, 200, 2)}


def test_a_state_is_shuffled_once_to_its_hour_and_a_second_needs_no_shuffle(spark):
    """The look-ahead joins on the partitioning at hand, marks go straight to their hour, and the log is read
    for spans that run backwards only if a look at the spans finds any."""
    log = [(0, 1), (5000, 2), (9000, 0)]
    rows = [(k, at(t), n) for k in (None, "v") for t, n in log] + [("w", at(0), 1)]
    spans = [(None, at(10), at(20)), (None, at(10), at(4000)), ("v", at(8000), at(7000))]
    used = activity(spark.createDataFrame(rows, STATES), spark.createDataFrame(spans, SPANS))
    plan = used._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert not any("sec#" in keys for keys in dealt)
    assert sum("_key#" in keys and "_block#" in keys and "coalesce" not in keys for keys in dealt) <= 3
    assert sum("coalesce" in keys for keys in dealt) <= 2 and "Subquery" in plan
    got = used.collect()
    assert [(r["warehouse_id"], r["on_s"], r["cluster_on_s"], r["util_s"], r["peak_concurrent"]) for r in sorted(got, key=str)] == [
        ("v", 9000, 13000, -1000, 1), (None, 9000, 13000, 4000, 2)]


def test_the_log_and_the_marks_move_once_and_narrow(spark, tmp_path):
    """Both readers of the log share one shuffle; the two marks of a span in one hour move as one row, and
    what is derived from marks is formed behind the shuffle."""
    log = [("v", at(t), n) for t, n in ((0, 1), (5000, 2), (9000, 0))]
    spans = [("v", at(10 * i), at(10 * i + 5)) for i in range(90)] + [("v", at(3000), at(4000)), ("v", at(1), None)]
    spark.createDataFrame(log, STATES).write.parquet(f"{tmp_path}/log")
    used = activity(spark.read.parquet(f"{tmp_path}/log"), spark.createDataFrame(spans, SPANS).coalesce(1))
    used = used.join(spark.createDataFrame([("v",)], "warehouse_id string"), "warehouse_id")
    assert [r["util_s"] for r in used.collect()] == [90 * 5 + 1000]
    plan = used._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[_key#", plan)
    marks = plan[plan.index("Exchange hashpartitioning(warehouse_id", plan.index("Generate inline(array(struct(here")):]
    assert "minute" not in marks.split("Union")[0] and "has_first" in plan


def test_a_decimal_is_cast_once(spark):
    plan = spark.createDataFrame([(1.5,)], "q double").select(exact(F.col("q"), "decimal(20,9)"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"cast\(q#\d+L? as decimal\(20,9\)\)", plan)) == 1


def test_unknown_overlap_method(spark):
    with pytest.raises(ValueError, match="join"):
        overlap_seconds(None, None, method="magic")


def test_results_do_not_depend_on_the_session_zone(spark):
    rows, spans = random_logs(11)
    build = lambda: activity(spark.createDataFrame(rows, STATES),
                             spark.createDataFrame(spans, SPANS))
    expected = sorted(map(tuple, build().collect()))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(map(tuple, build().collect())) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_peak_counts_starts_per_minute(spark):
    spans = [("a", at(s), None) for s in (0, 30, 59.9, 60, 61)]
    got = peak_per_bucket(spark.createDataFrame(spans, SPANS), "warehouse_id", "start_time")
    assert [tuple(r) for r in got.collect()] == [("a", 3)]


# pricing

def test_price_validity(spark):
    day = lambda d: datetime(2024, 1, d)
    prices = spark.createDataFrame(
        [("s", "DBU", "USD", day(1), day(10), 1.0), ("s", "DBU", "USD", day(10), None, 2.0),
         ("s", "DBU", "EUR", day(1), None, 9.0), ("s", "HOUR", "USD", day(1), None, 5.0)],
        "sku_name string, usage_unit string, currency_code string,"
        " price_start_time timestamp_ntz, price_end_time timestamp_ntz, list_price double")
    ends = {"first": day(5), "border": day(10), "open": day(31), "early": datetime(2023, 12, 31),
            "late": datetime(2024, 2, 2)}
    usage = spark.createDataFrame(
        [("s", "DBU", t, n) for n, t in ends.items()],
        "sku_name string, usage_unit string, usage_end_time timestamp_ntz, n string")
    got = sorted((r["n"], r["list_price"])
                 for r in priced_usage(usage, prices, cfg=CFG).collect())
    assert got == [("border", 1.0), ("border", 2.0), ("first", 1.0), ("open", 2.0)]


def test_usage_is_summed_where_it_is_read(spark):
    """A price is looked up first, so no sum by hour of use moves."""
    usage = spark.range(500).selectExpr(
        "'w' as warehouse_id", "'S' as sku_name", "'DBU' as usage_unit", "cast(id as decimal(20,9)) as usage_quantity",
        "timestamp'2024-01-02 00:00:00' + make_dt_interval(0, cast(id as int)) as usage_start_time",
        "timestamp'2024-01-02 01:00:00' + make_dt_interval(0, cast(id as int)) as usage_end_time")
    prices = spark.sql("""select 'S' as sku_name, 'DBU' as usage_unit, 'USD' as currency_code,
        timestamp'2023-01-01 00:00:00' as price_start_time, cast(null as timestamp) as price_end_time,
        cast(0.25 as decimal(17,9)) as list_price""")
    cost = warehouse_cost(usage, prices, cfg=CFG)
    plan = cost._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*usage_end_time", plan)
    assert [(float(r["dbus_30d"]), float(r["dollars_30d"])) for r in cost.collect()] == [(124750.0, 31187.5)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_amounts_on_half_cents_do_not_depend_on_the_layout(spark, partitions):
    rng = random.Random(9)
    # 1004.09 units at 0.50, as floating-point numbers whose sum is not exact.
    parts = [round(rng.uniform(0.01, 3.0), 3) for _ in range(500)]
    parts.append(round(1004.09 - sum(parts), 3))
    rows = [("w", "SQL", None, None, "s", "DBU", q, T0, T0 + timedelta(hours=i % 40)) for i, q in enumerate(parts)]
    usage = spark.createDataFrame(
        rows, "warehouse_id string, billing_origin_product string, workspace_id string, job_id string, sku_name string,"
        " usage_unit string, usage_quantity double, usage_start_time timestamp_ntz, usage_end_time timestamp_ntz")
    prices = spark.createDataFrame(
        [("s", "DBU", "USD", datetime(2020, 1, 1), None, 0.5)],
        "sku_name string, usage_unit string, currency_code string,"
        " price_start_time timestamp_ntz, price_end_time timestamp_ntz, list_price double")
    got = warehouse_cost(conform(usage, "usage").repartition(partitions), conform(prices, "list_prices"), cfg=CFG)
    row = got.select("dbus_30d", "dollars_30d", cents(F.col("dollars_30d")).alias("cents")).first()
    assert (str(row["dbus_30d"]), row["dollars_30d"], row["cents"]) == ("1004.090000000", Decimal("502.045"), 502.05)


def test_numbers_that_do_not_fit_are_refused(spark):
    usage = spark.createDataFrame([(1e12,)], "q double")
    with pytest.raises(Exception, match="no number for"):
        usage.select(exact(F.col("q"), "decimal(20,9)")).collect()


# percentiles and statistics

@pytest.mark.parametrize("seed", range(3))
def test_percentiles_match_sorted_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(300)]
    rows += [("lonely", 7), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r for r in summarise(
        counts, ["k"], value="v", weight="n", percents={"p50": 50, "p95": 95},
        sums={"rows": F.col("n")}).collect()}
    for k in ("a", "b", "lonely", "void"):
        ordered = sorted(v for g, v in rows if g == k and v is not None)
        rank = lambda p: ordered[-(-p * len(ordered) // 100) - 1] if ordered else None
        assert (got[k]["p50"], got[k]["p95"]) == (rank(50), rank(95))
        assert got[k]["rows"] == sum(g == k for g, _ in rows)


@pytest.mark.parametrize("spread", [3, 2_000, 10 ** 12])
def test_percentiles_over_many_blocks_of_values(spark, spread):
    rng = random.Random(spread)
    rows = [("hot" if i % 3 else None, int(rng.expovariate(5 / spread)) - spread // 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["k"]: r for r in summarise(
        counts, ["k"], value="v", weight="n", percents={"p1": 1, "p50": 50, "p95": 95, "p100": 100},
        sums={"rows": F.col("n"), "total": F.col("n") * F.col("v")}).collect()}
    for k in ("hot", None):
        ordered = sorted(v for g, v in rows if g == k)
        rank = lambda p: ordered[-(-p * len(ordered) // 100) - 1]
        assert [got[k][f"p{p}"] for p in (1, 50, 95, 100)] == [rank(p) for p in (1, 50, 95, 100)]
        assert (got[k]["rows"], got[k]["total"]) == (len(ordered), sum(ordered))


def test_blocks_of_values_keep_the_order(spark):
    values = sorted({s * (2 ** i + d) for i in range(62) for d in (-1, 0, 1) for s in (-1, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    blocks = [r["b"] for r in df.select("v", value_block(F.col("v")).alias("b")).orderBy("v").collect()]
    assert blocks == sorted(blocks)


def test_no_task_gets_all_the_durations_of_a_warehouse(spark):
    """One warehouse with all queries: nothing is windowed over it alone but rows for blocks of values."""
    df = spark.range(40_000).selectExpr(
        "'w' as warehouse_id", "(id * 7919) % 1000003 as total_task_duration_ms",
        "0L as waiting_for_compute_duration_ms", "0L as waiting_at_capacity_duration_ms", "0L as spilled_local_bytes")
    stats = query_stats(df)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    over = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert over and all("_block" in keys or "_block" in order or not order for keys, order in over)
    assert plan.count("Exchange hashpartitioning(warehouse_id") - plan.count("ReusedExchange") <= 4
    dealt = df.select("warehouse_id", value_block(F.col("total_task_duration_ms")).alias("b")).groupBy("b").count()
    assert dealt.count() > 200 and dealt.agg(F.max("count")).first()[0] < 0.05 * 40_000
    assert stats.first()["query_count"] == 40_000


def test_query_stats_treats_missing_waits_as_zero(spark):
    rows = [("w", 1000, None, None, 0), ("w", 3000, 4000, None, 2 ** 30), ("w", 5000, None, 2000, None)]
    df = spark.createDataFrame(
        rows, "warehouse_id string, total_task_duration_ms bigint,"
        " waiting_for_compute_duration_ms bigint, waiting_at_capacity_duration_ms bigint,"
        " spilled_local_bytes bigint")
    r = query_stats(df).first()
    assert (r["query_count"], r["p50_task_s"], r["p95_task_s"]) == (3, 3.0, 5.0)
    assert (r["avg_queue_s"], r["spill_gb"]) == (2.0, 1.0)


RUNS = ("workspace_id string, job_id string, run_id string, period_start_time timestamp_ntz,"
        " period_end_time timestamp_ntz, result_state string, termination_code string")


def test_run_stats_count_runs_but_measure_rows(spark):
    rows = [("ws", "j", "1", at(0), at(600), "FAILED", "DRIVER_ERROR"),
            ("ws", "j", "1", at(700), at(1900), "FAILED", "INIT_SCRIPT_FAILURE"),
            ("ws", "j", "2", at(0), at(0), "SUCCEEDED", "SUCCESS"),
            ("ws", "j", "3", at(0), None, "FAILED", "DRIVER_ERROR"),
            ("ws", "j", "4", datetime(2023, 1, 1), at(0), "FAILED", "DRIVER_ERROR"),
            ("ws", None, "5", at(0), at(9), None, None)]
    got = run_stats(spark.createDataFrame(rows, RUNS), cfg=CFG).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["run_count_30d"], r["failed_runs"]) == (2, 2)
    assert (r["infra_failure_count"], r["init_script_failure_count"]) == (1, 1)
    assert (r["avg_run_minutes"], r["p50_run_minutes"], r["p95_run_minutes"]) == (10.0, 10.0, 20.0)
    assert r["short_run_share_pct"] == pytest.approx(200 / 3)


def test_repeated_edges_weigh_sums_but_not_counts(spark):
    day = datetime(2024, 1, 20).date()
    lineage = spark.createDataFrame(
        [("t", "TABLE", "q1", "u1", day), ("t", "TABLE", "q1", "u1", day),
         ("t", "TABLE", "q1", "u2", day), ("t", "TABLE", "light", "u1", day),
         ("t", "VIEW", "q1", "u9", day), (None, "TABLE", "q1", "u9", day),
         ("t", "TABLE", "q1", "u9", datetime(2023, 12, 31).date())],
        "source_table_full_name string, source_type string, entity_id string,"
        " created_by string, event_date date")
    heavy = spark.createDataFrame(
        [("q1", 10, 100, 1)], "statement_id string, total_task_duration_ms bigint,"
        " read_bytes bigint, spilled_local_bytes bigint")
    r = table_reads(lineage, heavy, cfg=CFG).first()
    assert (r["readers"], r["users"], r["ms"], r["read_b"], r["spill_b"]) == (2, 2, 30, 300, 3)


def test_traffic_keeps_statements_without_a_warehouse(spark):
    rows = [(None, "u1", 10, 5), (None, "u2", 20, 5), ("w", None, None, None), ("w", "u", 30, 1)]
    df = spark.createDataFrame(rows, "warehouse_id string, executed_by string,"
                                     " total_task_duration_ms bigint, read_bytes bigint")
    got = {r["warehouse_id"]: r for r in warehouse_traffic(df).collect()}
    assert (got[None]["n"], got[None]["users"], got[None]["p50_s"]) == (2, 2, 0.01)
    assert (got["w"]["n"], got["w"]["users"], got["w"]["timed"], got["w"]["p95_s"]) == (2, 1, 1, 0.03)
