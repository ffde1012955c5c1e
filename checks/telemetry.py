"""Telemetry relations projected from the supplied test tables.

Every projection covers its whole base table. One text serves both engines; the
braces hold the few spots where the dialects differ.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tellwise import Telemetry

_SPARK = {"ts": "timestamp_ntz", "pair": "explode(array(0, 1))",
          "once_or_twice": "explode(sequence(1, case when event_id % 5 = 0 then 2 else 1 end))"}
_DUCKDB = {"ts": "timestamp", "pair": "unnest([0, 1])",
           "once_or_twice": "unnest(range(case when event_id % 5 = 0 then 2 else 1 end))"}

# user -> warehouse: three users share two warehouses; warehouses 3, 7, 11.. idle
_HOME = "cast(floor(user_id * 2 / 3) as bigint)"
_BUSY = f"({_HOME} - case when {_HOME} % 4 = 3 then 1 else 0 end)"

_PROJECTIONS = {
    "warehouses": """
        select 'wh-' || cast(k as string) as warehouse_id,
               case when k % 13 = 11 then 'tmp-wh-' else 'wh_' end || cast(k as string)
                 || case when v = 0 then '_old' else '' end as warehouse_name,
               case (k * 5 + v) % 9 when 0 then '2X_SMALL' when 1 then 'X_SMALL'
                 when 2 then 'SMALL' when 3 then 'MEDIUM' when 4 then 'LARGE'
                 when 5 then 'X_LARGE' when 6 then '2X_LARGE' when 7 then '3X_LARGE'
                 else '4X_LARGE' end as warehouse_size,
               case k % 3 when 0 then 'CLASSIC' when 1 then 'PRO' else 'SERVERLESS' end
                 as warehouse_type,
               cast(5 + (k % 5) * 10 as bigint) as auto_stop_minutes,
               cast(1 as bigint) as min_clusters,
               cast(1 + k % 2 as bigint) as max_clusters,
               {ts} '2023-12-01 00:00:00' + interval '1' day * v as change_time
        from (select s_suppkey as k, {pair} as v from supplier) s""",
    "warehouse_events": f"""
        select 'wh-' || cast({_HOME} as string) as warehouse_id,
               case when v = 0 then ts - interval '20' second
                    else ts + interval '1' second
                         * cast(30 + 300 * (user_id % 3) as int) end as event_time,
               cast(case when v = 0 then 1 + event_id % 3 else 0 end as bigint)
                 as cluster_count
        from (select user_id, event_id, ts, {{pair}} as v from events) e""",
    "query_history": f"""
        select 'q-' || cast(event_id as string) as statement_id,
               'u-' || cast(user_id as string) as executed_by,
               'wh-' || cast({_BUSY} as string) as warehouse_id,
               begun as start_time,
               case when event_id % 41 = 7 then null
                    else begun + interval '1' second * cast(floor(task_s) as int)
                    end as end_time,
               cast(round(task_s * 1000) as bigint) as total_task_duration_ms,
               case when event_type = 'error' then cast(round(value * 400) as bigint) end
                 as waiting_for_compute_duration_ms,
               case when {_BUSY} % 8 = 1 then cast(round(value * 200) as bigint) end
                 as waiting_at_capacity_duration_ms,
               case when user_id % 8 in (1, 3, 5) and value > 80
                    then cast(round(value * 20000000) as bigint)
                    else cast(0 as bigint) end as spilled_local_bytes,
               cast(round(value * 50000000) as bigint) as read_bytes,
               cast(round(value * 10000000) as bigint) * (user_id % 10) as pruned_files_bytes,
               case when event_type = 'purchase' then 'INSERT' else 'SELECT' end
                 as statement_type,
               case when event_type = 'error' then 'FAILED' else 'FINISHED' end
                 as execution_status,
               'SELECT c' || cast(user_id % 40 as string) || chr(10) || ' FROM T_'
                 || event_type || '  WHERE k = ' || regexp_extract(props, '[0-9]+', 0)
                 || ' AND r < ' || cast(cast(value as decimal(10,2)) as string)
                 || ' AND n = ' || chr(39) || event_type || ' ' || props || chr(39)
                 as statement_text
        from (select *,
                     value * case when user_id % 3 = 0 then 0.3 else 1.0 end as task_s,
                     case when {_BUSY} % 10 = 4
                          then {{ts}} '2024-01-01 09:00:00' + interval '7' day
                               * cast(floor((dayofmonth(ts) - 1) / 7) as int)
                          else ts end as begun
              from events) e""",
    "list_prices": """
        select sku_name, 'DBU' as usage_unit,
               case when cur = 0 then 'USD' else 'EUR' end as currency_code,
               case when v = 0 then {ts} '2023-01-01 00:00:00'
                    else {ts} '2024-01-15 00:00:01' end as price_start_time,
               case when v = 0 then {ts} '2024-01-15 00:00:00' end as price_end_time,
               cast(0.2 + 0.1 * r_regionkey + 0.05 * v + 0.3 * cur as double) as list_price
        from (select r_regionkey, sku_name, v, {pair} as cur
              from (select r_regionkey, {pair} as v,
                           case r_regionkey when 0 then 'SQL_CLASSIC' when 1 then 'SQL_PRO'
                             when 2 then 'SQL_SERVERLESS' when 3 then 'JOBS_COMPUTE'
                             else 'Jobs_Serverless' end as sku_name
                    from region) r) p""",
    "usage": """
        select 'SQL' as billing_origin_product, 'ws-0' as workspace_id,
               'wh-' || cast(l_suppkey as string) as warehouse_id,
               cast(null as string) as job_id,
               case l_suppkey % 3 when 0 then 'SQL_CLASSIC' when 1 then 'SQL_PRO'
                 else 'SQL_SERVERLESS' end as sku_name,
               case when l_suppkey % 12 = 5 then 'HOUR' else 'DBU' end as usage_unit,
               l_quantity / case when l_suppkey % 9 = 4 then 2000 else 10 end
                 as usage_quantity,
               {ts} '2024-01-01 00:00:00'
                 + interval '1' day * cast(dayofyear(l_shipdate) % 30 as int)
                 + interval '1' hour * l_linenumber as usage_start_time,
               {ts} '2024-01-01 01:00:00'
                 + interval '1' day * cast(dayofyear(l_shipdate) % 30 as int)
                 + interval '1' hour * l_linenumber as usage_end_time
        from lineitem
        union all
        select 'JOBS', 'ws-' || cast(j % 2 as string), cast(null as string),
               'job-' || cast(j as string),
               case when j % 17 = 5 or o_orderstatus = 'F' then 'Jobs_Serverless'
                    else 'JOBS_COMPUTE' end,
               'DBU',
               o_totalprice / case when j % 11 = 3 then 10000000 else 100000 end,
               {ts} '2024-01-01 00:00:00'
                 + interval '1' day * cast(dayofyear(o_orderdate) % 30 as int),
               {ts} '2024-01-01 01:00:00'
                 + interval '1' day * cast(dayofyear(o_orderdate) % 30 as int)
        from (select *, cast(floor(o_custkey / 10) as bigint) as j from orders) o""",
    "jobs": """
        select 'ws-' || cast(j % 2 as string) as workspace_id,
               'job-' || cast(j as string) as job_id,
               case when j % 10 = 9 then 'test-job-' else 'job_' end || cast(j as string)
                 || case when v = 0 then '_old' else '' end as job_name,
               'u-' || cast(j as string) as creator_id,
               {ts} '2023-12-01 00:00:00' + interval '1' day * v as change_time
        from (select c_custkey as j, {pair} as v from customer) c""",
    "job_runs": """
        select 'ws-' || cast(user_id % 2 as string) as workspace_id,
               'job-' || cast(user_id as string) as job_id,
               cast(case when user_id % 7 = 6 then floor(dayofmonth(ts) / 15)
                    when user_id % 7 = 5 then dayofmonth(ts) else event_id end as bigint)
                 as run_id,
               ts as period_start_time,
               case when event_id % 50 = 0 then null
                    else ts + interval '1' second * cast(floor(
                      (user_id % 4) * 600 + value * 12 * (user_id % 6)) as int)
                    end as period_end_time,
               case when event_type = 'error' then 'FAILED' else 'SUCCEEDED' end
                 as result_state,
               case when event_type = 'error' and user_id % 12 in (1, 2, 7)
                    then 'CLUSTER_ERROR'
                    when event_type = 'error' and user_id % 12 = 4
                    then 'INIT_SCRIPT_FAILURE'
                    when event_type = 'error' then 'RUN_EXECUTION_ERROR'
                    else 'SUCCESS' end as termination_code
        from events""",
    "lineage": """
        select case when event_id % 97 = 0 then cast(null as string)
                    else 'main.s.t' || cast(user_id % 60 as string) end
                 as source_table_full_name,
               case when event_id % 11 = 0 then 'VIEW' else 'TABLE' end as source_type,
               'q-' || cast(event_id as string) as entity_id,
               'u-' || cast(user_id as string) as created_by,
               cast(ts as date) as event_date
        from (select *, {once_or_twice} as copy from events) e""",
}

BASE_TABLES = ("supplier", "events", "region", "lineitem", "orders", "customer")


def duckdb_ctes() -> dict[str, str]:
    """``fx_<source>`` -> DuckDB query text."""
    return {f"fx_{name}": text.format(**_DUCKDB) for name, text in _PROJECTIONS.items()}


def projected(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named sources (all by default) as Spark relations."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES}
    views = {t: "{" + t + "}" for t in BASE_TABLES}

    def project(name: str) -> DataFrame:
        text = _PROJECTIONS[name].format(**_SPARK)
        for table in BASE_TABLES:
            text = text.replace(f"from {table}", f"from {views[table]}")
        used = {t: df for t, df in tables.items() if views[t] in text}
        return spark.sql(text, **used)

    return {name: project(name) for name in names or _PROJECTIONS}


@lru_cache(maxsize=4)
def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    """All sources; only their definitions are kept, never data."""
    return Telemetry.from_frames(**projected(spark, sf_dir))
