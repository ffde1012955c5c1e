"""Independent DuckDB statements for the registered queries.

Named steps are kept in one dictionary per threshold profile; a statement pulls in
the steps it mentions. Ties, roundings and text forms are spelled out here again
rather than taken from the library; only labels and thresholds are shared.
"""

from __future__ import annotations

import re
from datetime import timedelta

from checks.profiles import DEFAULT, RECENT, TIGHT, ZERO_FLOOR
from checks.telemetry import duckdb_ctes
from tellwise import Thresholds
from tellwise.config import SIZE_LADDER
from tellwise.plans.labels import (
    CHECKLIST_BLOCKER, CHECKLIST_GENERIC, WAREHOUSE_RULES, WORKLOAD_RULES,
)
from tellwise.plans.jobs import COLUMNS as JOB_COLUMNS
from tellwise.plans.rollups import JOB_TABLE, WAREHOUSE_TABLE, WORKLOAD_TABLE
from tellwise.plans.warehouses import COLUMNS as WAREHOUSE_COLUMNS

WORKLOAD_COLUMNS = (
    "category", "selection_criteria", "recommended_action", "target_or_sample", "target", "query_sample",
    "exec_count", "total_compute_s", "compute_hours", "avg_compute_s", "avg_spill_gb", "pruning_pct",
    "total_read_gb",
)


def _r(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,12)), {digits}) as double)"


def _cents(x: str, digits: int = 2) -> str:
    """An exact decimal, rounded once."""
    return f"cast(round(cast({x} as decimal(38,18)), {digits}) as double)"


def _cents_text(x: str, digits: int = 2) -> str:
    return f"cast(cast(round(cast({x} as decimal(38,18)), {digits}) as decimal(38,{digits})) as varchar)"


def _dec(x: str, digits: int) -> str:
    return (f"cast(cast(round(cast({x} as decimal(38,12)), {digits})"
            f" as decimal(38,{digits})) as varchar)")


def _s(x: str) -> str:
    return f"cast({x} as varchar)"


def _sec(x: str) -> str:
    return f"cast(floor(epoch({x})) as bigint)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fingerprint(text: str) -> str:
    blanked = f"lower({text})"
    for pattern, by in (("'[^']*'", "?"), (r"\b\d+\b", "?"), (r"\s+", " ")):
        blanked = f"regexp_replace({blanked}, {_q(pattern)}, {_q(by)}, 'g')"
    return f"md5({blanked})"


def _ts(value) -> str:
    return f"timestamp '{value.isoformat(sep=' ')}'"


def _rate_rows(cfg: Thresholds) -> tuple[str, str]:
    sizes = ", ".join(f"({i}, {_q(s)}, {cfg.dbu_rate[s]}::double)"
                      for i, s in enumerate(SIZE_LADDER))
    types = ", ".join(f"({_q(t)}, {r}::double)" for t, r in cfg.type_rate.items())
    return sizes, types


def _warehouse_steps(c: Thresholds) -> dict[str, str]:
    lo = _ts(c.window_start)
    sizes, types = _rate_rows(c)
    labels = ", ".join(f"({_q(k)}, {_q(v)}, {i})"
                       for i, (k, v) in enumerate(WAREHOUSE_RULES.items()))
    exclude = ("true" if c.warehouse_exclude_name_pattern is None else
               "not regexp_matches(warehouse_name, "
               f"{_q(c.warehouse_exclude_name_pattern)})")
    return {
        "size_card": f"select * from (values {sizes}) t(pos, size, rate)",
        "type_card": f"select * from (values {types}) t(kind, rate)",
        "wh_labels": f"select * from (values {labels}) t(category, rule, place)",
        "wh_now": """
            select distinct on (warehouse_id) * exclude (change_time)
            from fx_warehouses order by warehouse_id, change_time desc, warehouse_name desc""",
        "wh_states": f"""
            select warehouse_id, cluster_count, event_time as w_start,
                   lead(event_time) over (partition by warehouse_id
                                          order by event_time, cluster_count) as w_end
            from fx_warehouse_events where event_time >= {lo}""",
        "wh_on": f"""
            select warehouse_id, sum(len) as on_s, sum(len * cluster_count) as cluster_on_s,
                   max(cluster_count) as max_clusters_observed
            from (select *, {_sec('w_end')} - {_sec('w_start')} as len
                  from wh_states where w_end is not null and cluster_count > 0)
            group by warehouse_id""",
        "wh_queries": f"""
            select * from fx_query_history
            where warehouse_id is not null and start_time >= {lo}""",
        "wh_used": f"""
            select q.warehouse_id,
                   sum({_sec('least(end_time, w_end)')}
                       - {_sec('greatest(start_time, w_start)')}) as util_s
            from wh_queries q, wh_states s
            where q.warehouse_id = s.warehouse_id and s.cluster_count > 0
              and w_end is not null and end_time is not null
              and w_start < end_time and w_end > start_time
            group by q.warehouse_id""",
        "wh_load": """
            select warehouse_id, count(*) as query_count,
                   quantile_disc(total_task_duration_ms, 0.5) / 1000.0 as p50_task_s,
                   quantile_disc(total_task_duration_ms, 0.95) / 1000.0 as p95_task_s,
                   avg(ifnull(waiting_for_compute_duration_ms, 0)
                       + ifnull(waiting_at_capacity_duration_ms, 0)) / 1000.0 as avg_queue_s,
                   cast(sum(spilled_local_bytes) as double) / 1073741824.0 as spill_gb
            from wh_queries group by warehouse_id""",
        "wh_peak": """
            select warehouse_id, max(n) as peak_concurrent
            from (select warehouse_id, count(*) as n from wh_queries
                  group by warehouse_id, time_bucket(interval '1 minute', start_time))
            group by warehouse_id""",
        "priced": f"""
            select u.* replace (cast(u.usage_quantity as decimal(20,9)) as usage_quantity),
                   cast(p.list_price as decimal(17,9)) as list_price from fx_usage u
            join (select *, coalesce(price_end_time, {_ts(c.as_of + timedelta(days=1))}) as till
                  from fx_list_prices where currency_code = 'USD') p
              on p.sku_name = u.sku_name and p.usage_unit = u.usage_unit
             and u.usage_end_time >= p.price_start_time and u.usage_end_time <= p.till
            where u.usage_start_time >= {lo}""",
        "wh_spend": """
            select warehouse_id, sum(usage_quantity) as dbus_30d,
                   sum(usage_quantity * list_price) as dollars_30d
            from priced where warehouse_id is not null group by warehouse_id""",
        "wh_base": f"""
            select w.*, on_s / 3600.0 as hours_on, ifnull(util_s, 0) / 3600.0 as hours_utilized,
                   greatest(0, on_s - ifnull(util_s, 0)) / 3600.0 as hours_idle,
                   case when query_count > 0 then least(100.0,
                     {_r("100.0 * ifnull(util_s, 0) / nullif(cluster_on_s, 0)", 1)}) end as util_pct,
                   query_count, p50_task_s, p95_task_s, avg_queue_s, spill_gb,
                   peak_concurrent, dollars_30d, dbus_30d
            from wh_now w join wh_on using (warehouse_id)
            left join wh_used using (warehouse_id)
            left join wh_load using (warehouse_id)
            left join wh_peak using (warehouse_id)
            left join wh_spend using (warehouse_id)""",
        "wh_flags": f"""
            select b.*, sc.pos, sc.rate as size_rate, tc.rate as kind_rate,
                   ifnull(hours_utilized / nullif(hours_on, 0), 0) as share,
                   ifnull(spill_gb / nullif(query_count, 0) > {c.size_up_min_spill_gb_per_query}, false)
                     or ifnull(avg_queue_s > {c.size_up_min_avg_queue_s}, false) as grow,
                   ifnull(pos >= {SIZE_LADDER.index('LARGE')} and ifnull(spill_gb, 0) = 0
                     and p50_task_s < {c.size_down_max_p50_s} and p95_task_s < {c.size_down_max_p95_s}
                     and avg_queue_s < {c.size_down_max_avg_queue_s}
                     and query_count >= {c.size_down_min_queries}, false) as shrink
            from wh_base b left join size_card sc on sc.size = b.warehouse_size
            left join type_card tc on tc.kind = b.warehouse_type""",
        "wh_moves": f"""
            select f.*,
                   case when warehouse_type in ('CLASSIC', 'PRO')
                     and ifnull(100.0 - util_pct, 100.0) > {c.migration_min_idle_pct}
                     and {c.type_rate['SERVERLESS']}::double / kind_rate * share
                         < {c.migration_max_cost_ratio}
                     then 'SERVERLESS' else warehouse_type end as rec_type,
                   case when grow then least(pos + 1, {len(SIZE_LADDER) - 1})
                        when shrink then pos - 1 else pos end as new_pos,
                   cast(case when ifnull(peak_concurrent, 0) = 0 then 1
                        when grow then max_clusters
                        else least({c.max_cluster_ceiling}, greatest(1,
                          ceil(peak_concurrent / {c.queries_per_cluster_target}::double)))
                        end as bigint) as rec_max_clusters
            from wh_flags f""",
        "wh_costed": f"""
            select m.*, ifnull(n.size, m.warehouse_size) as rec_size,
                   greatest({c.cost_multiplier_floor}::double,
                     ifnull(n.rate / m.size_rate, 1.0::double)
                     * ifnull(t.rate / m.kind_rate, 1.0::double)
                     * case when m.rec_type <> m.warehouse_type then share else 1.0::double end)
                     as factor
            from wh_moves m left join size_card n on n.pos = m.new_pos
            left join type_card t on t.kind = m.rec_type""",
        "wh_all": f"""
            select *, case
                when ifnull(query_count, 0) = 0
                     and ifnull(dollars_30d, 0) >= {c.decommission_min_cost_30d}
                  then 'DECOMMISSION_CANDIDATE'
                when factor < 1 then 'COST_REDUCE'
                when factor > 1 then 'PERFORMANCE'
                when rec_max_clusters > max_clusters then 'CONCURRENCY'
                when rec_max_clusters < max_clusters then 'RIGHTSIZE'
                when tidy then 'HOUSEKEEPING' end as category
            from (select *, warehouse_type in ('CLASSIC', 'PRO')
                    and auto_stop_minutes > {c.auto_stop_threshold_minutes} as tidy
                  from wh_costed)""",
        "wh_report": f"""
            select a.category, l.rule as selection_criteria,
                   case when a.category = 'DECOMMISSION_CANDIDATE'
                     then 'DELETE - 0 queries / 30d, $' || {_cents_text('coalesce(dollars_30d, 0)')} || ' burned'
                     else nullif(array_to_string(list_filter([
                       nullif(array_to_string(list_filter([
                         case when rec_type <> warehouse_type
                              then 'MIGRATE ' || warehouse_type || ' -> SERVERLESS' end,
                         case when rec_size <> warehouse_size
                              then 'RESIZE ' || warehouse_size || ' -> ' || rec_size end],
                         lambda part: part is not null), ' + '), ''),
                       case when rec_max_clusters > max_clusters then
                              'RAISE max_clusters ' || {_s('max_clusters')} || ' -> '
                              || {_s('rec_max_clusters')}
                              || case when util_pct >= {c.raise_warn_high_util_pct}
                                      then ' (peak-cost may grow significantly)'
                                      when util_pct >= {c.raise_warn_modest_util_pct}
                                      then ' (peak-cost may grow modestly)' else '' end
                            when rec_max_clusters < max_clusters then
                              'CAP max_clusters ' || {_s('max_clusters')} || ' -> '
                              || {_s('rec_max_clusters')} end,
                       case when tidy then 'AUTO-STOP ' || {_s('auto_stop_minutes')}
                              || 'm -> {c.auto_stop_target_minutes}m' end],
                       lambda part: part is not null), ' + '), '') end as recommended_action,
                   warehouse_id, warehouse_name, warehouse_size as current_size, rec_size,
                   warehouse_type as current_type, rec_type,
                   max_clusters as current_max_clusters, rec_max_clusters,
                   auto_stop_minutes, util_pct as utilization_pct,
                   {_r('hours_idle', 1)} as idle_hours_30d, query_count,
                   {_r('p50_task_s', 1)} as p50_task_s, {_r('p95_task_s', 1)} as p95_task_s,
                   {_r('avg_queue_s', 1)} as avg_queue_s, {_r('spill_gb', 2)} as spill_gb,
                   peak_concurrent,
                   {_cents('dollars_30d')} as current_cost_30d,
                   {_r('dollars_30d * factor', 2)} as projected_cost_30d,
                   {_r('dollars_30d * (1.0::double - factor)', 2)} as projected_cost_delta_30d,
                   {_r('100.0::double * (1.0::double - factor)', 1)} as cost_delta_pct
            from wh_all a left join wh_labels l using (category)""",
        "wh_kept": f"""
            select *, case when category = 'DECOMMISSION_CANDIDATE' then current_cost_30d
                      else greatest(0.0, projected_cost_delta_30d) end as effective_savings_30d
            from wh_report
            where category is not null and recommended_action is not null and {exclude}
              and (category not in ('COST_REDUCE', 'PERFORMANCE')
                   or abs(projected_cost_delta_30d) >= {c.min_delta_threshold})""",
        "wh": f"""
            select * from (select *, case when category = 'DECOMMISSION_CANDIDATE' then 95
                else cast(least(100.0, {_r('''50.0 + least(30.0, ifnull(query_count, 0) / 10.0)
                  + least(20.0, abs(ifnull(cost_delta_pct, 0)) / 2.0)''', 0)}) as int)
                end as confidence from wh_kept)
            where confidence >= {c.min_confidence}
              and ifnull(effective_savings_30d, 0) >= {c.min_savings_30d}""",
    }


_WORKLOAD_COLUMNS = ("category", "recommended_action", "target", "query_sample",
                     "exec_count", "total_compute_s", "avg_compute_s", "avg_spill_gb",
                     "pruning_pct", "total_read_gb")


def _detector(source: str, where: str = "true", **columns: str) -> str:
    defaults = {"target": "cast(null as varchar)", "query_sample": "cast(null as varchar)"}
    picked = ", ".join(
        f"{columns.get(n) or defaults.get(n, 'cast(null as double)')} as {n}"
        for n in _WORKLOAD_COLUMNS)
    return f"select {picked} from {source} where {where}"


def _workload_steps(c: Thresholds) -> dict[str, str]:
    lo, gb = _ts(c.window_start), "1073741824.0::double"
    labels = ", ".join(f"({_q(k)}, {_q(v)}, {i})"
                       for i, (k, v) in enumerate(WORKLOAD_RULES.items()))

    def totals(where: str) -> str:
        return f"""
            select query_signature, count(*) as n, sum(total_task_duration_ms) as ms,
                   substr(min(statement_text), 1, 300) as sample,
                   cast(sum(read_bytes) as double) as read_b,
                   cast(sum(pruned_files_bytes) as double) as pruned_b,
                   avg(spilled_local_bytes) / {gb} as spill_gb
            from qt_heavy where {where} group by query_signature"""

    minutes = _dec("ms / 60000.0::double", 1)
    per_signature = dict(
        query_sample="sample", exec_count="n",
        total_compute_s=_r("ms / 1000.0::double", 1),
        avg_compute_s=_r("ms / n / 1000.0::double", 2))
    read_gb = _r(f"read_b / {gb}", 2)
    pct = "(pruned_b * 100.0::double / nullif(read_b + pruned_b, 0))"
    return {
        "qt_labels": f"select * from (values {labels}) t(category, selection_criteria, place)",
        "qt_selects": f"""
            select * from fx_query_history
            where execution_status = 'FINISHED' and statement_type = 'SELECT'
              and start_time >= {lo}""",
        "qt_heavy": f"""
            select *, {_fingerprint('statement_text')} as query_signature
            from qt_selects
            where statement_text is not null
              and total_task_duration_ms > {c.min_query_duration_s * 1000}""",
        "qt_totals": totals("true"),
        "qt_totals_big": totals(f"read_bytes >= {c.pruning_min_read_gb}::double * 1073741824"),
        "qt_totals_spill": totals("spilled_local_bytes > 0"),
        "qt_expensive": _detector(
            f"""(select *, {_r('ms / 1000.0::double', 1)} as rounded from qt_totals
                 order by rounded desc, query_signature
                 limit {c.top_expensive_queries_n})""",
            category="'EXPENSIVE_QUERY_REVIEW'",
            recommended_action=f"""'Top query - ' || {_s('n')} || ' runs, ' || {minutes}
                || ' min total. Open the query profile / review with AI for tuning.'""",
            total_read_gb=read_gb, **per_signature),
        "qt_repeated": _detector(
            "qt_totals",
            f"n >= {c.mv_min_executions} and ms / 1000.0::double >= {c.mv_min_total_compute_s}",
            category="'MATERIALIZED_VIEW_CANDIDATE'",
            recommended_action=f"""'Run ' || {_s('n')} || 'x - total ' || {minutes}
                || ' min compute. CREATE MATERIALIZED VIEW.'""",
            total_read_gb=read_gb, **per_signature),
        "qt_low_pruning": _detector(
            "qt_totals_big",
            f"n >= {c.pruning_min_executions} and {pct} < {c.pruning_max_pct}",
            category="'LIQUID_CLUSTERING_CANDIDATE'",
            recommended_action=f"""'Reads ' || {_dec(f'read_b / {gb}', 1)}
                || ' GB with only ' || {_dec(pct, 1)} || '% pruned over ' || {_s('n')}
                || ' runs. ALTER TABLE ... CLUSTER BY (filter columns).'""",
            pruning_pct=_r(pct, 1), total_read_gb=read_gb, **per_signature),
        "qt_high_spill": _detector(
            "qt_totals_spill",
            f"n >= {c.spill_min_executions} and spill_gb >= {c.spill_min_avg_gb}",
            category="'HIGH_SPILL_QUERY'",
            recommended_action=f"""'Avg ' || {_dec('spill_gb', 1)}
                || ' GB spill / query over ' || {_s('n')} || ' runs. Size up warehouse or '
                || 'rewrite (broadcast joins, narrow projections).'""",
            avg_spill_gb=_r("spill_gb", 2), **per_signature),
        "qt_reads": f"""
            select l.source_table_full_name as target, count(distinct l.entity_id) as readers,
                   count(distinct l.created_by) as users,
                   sum(h.total_task_duration_ms) as ms,
                   cast(sum(h.spilled_local_bytes) as double) / {gb} as spill_gb,
                   cast(sum(h.read_bytes) as double) / {gb} as read_gb
            from fx_lineage l left join qt_heavy h on h.statement_id = l.entity_id
            where l.source_type = 'TABLE' and l.source_table_full_name is not null
              and l.event_date >= date '{c.window_start_date}'
            group by l.source_table_full_name""",
        "qt_hot": _detector(
            "qt_reads",
            f"readers >= {c.hot_table_min_queries} and"
            f" ifnull(ms / 1000.0::double, 0) >= {c.hot_table_min_compute_s}",
            category="'HOT_TABLE_REVIEW'",
            recommended_action=f"""'Read by ' || {_s('readers')} || ' queries / '
                || {_s('users')} || ' users. High-leverage target - review LIQUID CLUSTERING'
                || ' + ENABLE PREDICTIVE OPTIMIZATION.'""",
            target="target", exec_count="readers",
            total_compute_s=_r("ms / 1000.0::double", 1),
            avg_spill_gb=_r("spill_gb", 2), total_read_gb=_r("read_gb", 2)),
        "qt_traffic": f"""
            select q.warehouse_id, any_value(w.warehouse_name) as warehouse_name,
                   count(*) as n, count(distinct executed_by) as users,
                   quantile_disc(total_task_duration_ms, 0.5) / 1000.0::double as p50,
                   quantile_disc(total_task_duration_ms, 0.95) / 1000.0::double as p95,
                   sum(total_task_duration_ms) as ms,
                   avg(total_task_duration_ms) as avg_ms,
                   cast(sum(read_bytes) as double) / {gb} as read_gb
            from qt_selects q left join wh_now w using (warehouse_id)
            group by q.warehouse_id""",
        "qt_fast_bi": _detector(
            "qt_traffic",
            f"n >= {c.subsecond_min_queries} and p50 < {c.subsecond_max_p50_s}"
            f" and users >= {c.subsecond_min_distinct_users}",
            category="'SUB_SECOND_BI_ENGINE_CANDIDATE'",
            recommended_action=f"""{_s('n')} || ' queries / ' || {_s('users')}
                || ' users / p50 ' || {_dec('p50', 2)} || 's, p95 ' || {_dec('p95', 2)}
                || 's. High-volume BI workload - qualifies for sub-second BI engine'
                || ' evaluation.'""",
            target="""'warehouse: ' || ifnull(warehouse_name, '?') || ' ('
                || warehouse_id || ')'""",
            exec_count="n", total_compute_s=_r("ms / 1000.0::double", 1),
            avg_compute_s=_r("avg_ms / 1000.0::double", 2), total_read_gb=_r("read_gb", 2)),
        "qt_found": " union all ".join(
            f"select * from {d}" for d in ("qt_fast_bi", "qt_expensive", "qt_repeated",
                                           "qt_low_pruning", "qt_high_spill", "qt_hot")),
        "qt_kept": """
            select category, selection_criteria, recommended_action,
                   coalesce(target, substr(query_sample, 1, 80)) as target_or_sample,
                   target, query_sample, exec_count, total_compute_s,
                   total_compute_s / 3600.0::double as compute_hours,
                   avg_compute_s, avg_spill_gb, pruning_pct, total_read_gb
            from qt_found join qt_labels using (category)""",
        "qt": f"""
            select * from (select *, cast(least(100.0,
                {_r('''40.0 + least(40.0, exec_count / 5.0)
                  + least(20.0, ifnull(total_compute_s, 0) / 600.0)''', 0)}) as int) as confidence
              from qt_kept)
            where confidence >= {c.min_confidence}""",
    }


def _job_steps(c: Thresholds) -> dict[str, str]:
    lo = _ts(c.window_start)
    exclude = ("true" if c.jobs_exclude_name_pattern is None else
               f"not regexp_matches(job_name, {_q(c.jobs_exclude_name_pattern)})")

    def ramp(x: str, best: float, worst: float, points: int) -> str:
        return (f"case when {x} is null then {points}.0 else greatest(0.0, least({points}.0,"
                f" {points}.0::double * ({worst}::double - {x}) / {worst - best}::double)) end")

    return {
        "jb_now": """
            select distinct on (workspace_id, job_id) workspace_id, job_id, job_name, creator_id
            from fx_jobs order by workspace_id, job_id, change_time desc, job_name desc""",
        "jb_runs": f"""
            select workspace_id, job_id, count(distinct run_id) as run_count_30d,
                   avg(len) / 60.0::double as avg_run_minutes,
                   quantile_disc(len, 0.5) / 60.0::double as p50_run_minutes,
                   quantile_disc(len, 0.95) / 60.0::double as p95_run_minutes,
                   100.0::double * count(*) filter (
                     len / 60.0 < {c.short_run_threshold_minutes}) / count(*) as short_run_share_pct,
                   count(*) filter (result_state = 'FAILED') as failed_runs,
                   count(*) filter (termination_code in ('CLUSTER_ERROR', 'DRIVER_ERROR',
                     'CLUSTER_REQUEST_LIMIT_EXCEEDED', 'INSTANCE_UNREACHABLE',
                     'UNEXPECTED_LAUNCH_FAILURE')) as infra_failure_count,
                   count(*) filter (termination_code = 'INIT_SCRIPT_FAILURE')
                     as init_script_failure_count
            from (select *, {_sec('period_end_time')} - {_sec('period_start_time')} as len
                  from fx_job_runs
                  where period_end_time is not null and period_start_time >= {lo})
            group by workspace_id, job_id""",
        "jb_spend": """
            select workspace_id, job_id,
                   ifnull(sum(usage_quantity) filter (not sl), 0) as classic_dbus_30d,
                   ifnull(sum(usage_quantity) filter (sl), 0) as serverless_dbus_30d,
                   ifnull(sum(usage_quantity * list_price) filter (not sl), 0)
                     as classic_dbu_cost_30d
            from (select *, contains(upper(sku_name), 'SERVERLESS') as sl from priced
                  where billing_origin_product = 'JOBS' and job_id is not null)
            group by workspace_id, job_id""",
        "jb_signals": f"""
            select n.*, r.* exclude (workspace_id, job_id), s.* exclude (workspace_id, job_id),
                   case when avg_run_minutes = 0 then 0.8::double
                        else least(0.8::double, {c.classic_startup_minutes}::double
                                                / avg_run_minutes) end as startup_share,
                   p95_run_minutes / nullif(p50_run_minutes, 0) as p95_p50_ratio,
                   100.0::double * failed_runs / nullif(run_count_30d, 0) as failure_rate_pct,
                   run_count_30d / 30.0::double as runs_per_day
            from jb_now n join jb_runs r using (workspace_id, job_id)
            join jb_spend s using (workspace_id, job_id)
            where classic_dbus_30d > 0""",
        "jb_scored": f"""
            select *,
                   {ramp('avg_run_minutes', c.short_run_threshold_minutes,
                         c.long_run_threshold_minutes, 30)} as score_duration,
                   least(20.0, 20.0::double * run_count_30d
                               / {c.high_frequency_runs_30d}::double) as score_frequency,
                   least(20.0, 20.0::double * (startup_share * 100.0::double)
                               / {c.high_startup_share_pct}::double) as score_startup,
                   {ramp('p95_p50_ratio', c.predictable_p95_p50_ratio,
                         c.unpredictable_p95_p50_ratio, 10)} as score_predictability,
                   if(infra_failure_count > 0, 20.0, 0.0) as score_infra_failures
            from jb_signals""",
        "jb_report": f"""
            select job_id, job_name, workspace_id, creator_id,
                   cast({_r('''score_duration + score_frequency + score_startup
                     + score_predictability + score_infra_failures''', 0)} as int) as fit_score,
                   run_count_30d, {_r('runs_per_day', 1)} as runs_per_day,
                   {_r('avg_run_minutes', 1)} as avg_run_minutes,
                   {_r('p50_run_minutes', 1)} as p50_run_minutes,
                   {_r('p95_run_minutes', 1)} as p95_run_minutes,
                   {_r('p95_p50_ratio', 2)} as p95_p50_ratio,
                   {_r('short_run_share_pct', 1)} as short_run_share_pct,
                   {_r('100.0::double * startup_share', 1)} as startup_share_pct,
                   {_r('failure_rate_pct', 1)} as failure_rate_pct,
                   infra_failure_count, init_script_failure_count,
                   {_r('classic_dbus_30d', 1)} as classic_dbus_30d,
                   {_cents('classic_dbu_cost_30d')} as classic_dbu_cost_30d,
                   {_r('serverless_dbus_30d', 1)} as serverless_dbus_30d,
                   {_r('score_duration', 0)} as pts_duration,
                   {_r('score_frequency', 0)} as pts_frequency,
                   {_r('score_startup', 0)} as pts_startup,
                   {_r('score_predictability', 0)} as pts_predictability,
                   {_r('score_infra_failures', 0)} as pts_infra_failures,
                   nullif(array_to_string(list_filter([
                     case when avg_run_minutes <= {c.short_run_threshold_minutes}
                          then 'short avg run (' || {_dec('avg_run_minutes', 1)} || ' min)' end,
                     case when run_count_30d >= {c.high_frequency_runs_30d}
                          then 'frequent (' || {_s('run_count_30d')} || ' runs/30d)' end,
                     case when startup_share * 100.0::double >= {c.high_startup_share_pct}
                          then 'startup is ' || {_dec('startup_share * 100.0::double', 0)}
                               || '% of wall-clock' end,
                     case when p95_p50_ratio <= {c.predictable_p95_p50_ratio}
                          then 'consistent runtime (low p95/p50 spread)' end,
                     case when infra_failure_count > 0 then {_s('infra_failure_count')}
                          || ' infra-flavored failure(s) serverless typically avoids' end],
                     lambda part: part is not null), '; '), '') as top_reasons,
                   if(init_script_failure_count > 0, {_q(CHECKLIST_BLOCKER)},
                      {_q(CHECKLIST_GENERIC)}) as migration_checklist,
                   if(init_script_failure_count > 0, 'BLOCKER', 'OK') as migration_risk
            from jb_scored
            where run_count_30d >= {c.min_runs_30d}
              and classic_dbu_cost_30d >= {c.min_classic_dbu_cost_30d}""",
        "jb_kept": f"""
            select *, case when fit_score < 40 then '< 40 (Skip)'
                           when fit_score < 60 then '40-59 (Marginal)'
                           when fit_score < 80 then '60-79 (Good)'
                           else '80-100 (Strong)' end as fit_bucket
            from jb_report where fit_score >= {c.min_fit_score} and {exclude}""",
        "jb": f"""
            select *, fit_score as confidence from jb_kept
            where fit_score >= {c.min_confidence}
              and ifnull(classic_dbu_cost_30d, 0) >= {c.min_savings_30d}""",
    }


def _cross_steps(c: Thresholds) -> dict[str, str]:
    top_lines = {
        "wh_lines": ("wh", "effective_savings_30d desc nulls last, warehouse_id",
                     f"""'- ' || warehouse_name || ' [' || category || '] save $'
                     || {_dec('effective_savings_30d', 0)} || ', confidence '
                     || {_s('confidence')} || ': ' || recommended_action"""),
        "qt_lines": ("qt", "total_compute_s desc nulls last, category, target_or_sample, recommended_action",
                     f"""'- [' || category || '] confidence ' || {_s('confidence')}
                     || ': ' || recommended_action"""),
        "jb_lines": ("jb", "fit_score desc, classic_dbu_cost_30d desc nulls last,"
                     " workspace_id, job_id",
                     f"""'- ' || job_name || ' fit ' || {_s('fit_score')} || '/100, $'
                     || {_dec('classic_dbu_cost_30d', 0)} || ': ' || ifnull(top_reasons, '')"""),
    }
    steps = {
        name: f"""
            select ifnull(string_agg(line, chr(10) order by place), '') as lines
            from (select {line} as line, row_number() over (order by {order}) as place
                  from {source}) where place <= 5"""
        for name, (source, order, line) in top_lines.items()}
    steps["kpi"] = f"""
            select (select count(distinct warehouse_id) from wh) as wh_count,
                   (select ifnull({_r('sum(effective_savings_30d)', 2)}, 0) from wh)
                     as wh_savings_30d,
                   (select ifnull({_r('sum(current_cost_30d)', 2)}, 0) from wh)
                     as wh_current_spend_30d,
                   (select count(*) from qt) as qt_count,
                   (select ifnull({_r('sum(total_compute_s) / 3600.0::double', 2)}, 0) from qt)
                     as qt_compute_hours,
                   (select count(*) from jb) as jb_count,
                   (select count(*) from jb where fit_score >= 70) as jb_high_fit,
                   (select ifnull({_r('sum(classic_dbu_cost_30d)', 2)}, 0) from jb)
                     as jb_addressable_spend"""
    steps["actions"] = f"""
            select 'warehouse' as source, category, warehouse_name as target,
                   {_r('effective_savings_30d', 2)} as impact_usd_30d,
                   recommended_action as detail from wh
            union all
            select 'jobs', 'JOB_TO_SERVERLESS', job_name,
                   {_r('ifnull(classic_dbu_cost_30d, 0)', 2)},
                   'fit ' || {_s('fit_score')} || '/100 - '
                   || ifnull(top_reasons, 'see migration_checklist') from jb
            union all
            select 'query_table', category, ifnull(target, substr(query_sample, 1, 60) || '...'),
                   0.0::double, recommended_action from qt"""
    def shown(n: str) -> str:
        number = f"cast(cast(round(try_cast({n} as decimal(38,12)), 2) as decimal(38,2)) as varchar)"
        return f"case when typeof({n}) = 'DOUBLE' then {number} else {_s(n)} end"

    titles = {"wh_md": "Warehouse recommendations", "qt_md": "Query/table optimizations",
              "jb_md": "Jobs -> serverless"}
    for name, (source, columns, order) in {
        "wh_md": ("wh", WAREHOUSE_COLUMNS, "effective_savings_30d desc nulls last, warehouse_id"),
        "qt_md": ("qt", WORKLOAD_COLUMNS,
                  "total_compute_s desc nulls last, category, target_or_sample, recommended_action"),
        "jb_md": ("jb", JOB_COLUMNS, "fit_score desc, workspace_id, job_id"),
    }.items():
        names = [*columns, "confidence"]
        row = " || ' | ' || ".join(
            f"replace(regexp_replace(ifnull({shown(n)}, ''), '[\\r\\n]+', ' ', 'g'), '|', '\\|')" for n in names)
        head = "| " + " | ".join(names) + " |"
        steps[name] = f"""
            select case when count(*) > 0 then '## {titles[name]}' || chr(10)
                     || {_q(head)} || chr(10) || '|' || repeat('---|', {len(names)}) || chr(10)
                     || string_agg(line, chr(10) order by place) end as lines
            from (select '| ' || {row} || ' |' as line,
                         row_number() over (order by {order}) as place
                  from {source}) where place <= 10"""
    return steps


def _steps(cfg: Thresholds) -> dict[str, str]:
    return {**duckdb_ctes(), **_warehouse_steps(cfg), **_workload_steps(cfg),
            **_job_steps(cfg), **_cross_steps(cfg)}


_PROFILES = {"default": _steps(DEFAULT), "tight": _steps(TIGHT), "recent": _steps(RECENT),
             "zero_floor": _steps(ZERO_FLOOR)}


def _statement(body: str, profile: str = "default") -> str:
    steps = _PROFILES[profile]
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:from|join|,)\s+([a-z_]+)\b", text)):
            if word in steps and word not in needed:
                visit(steps[word])
                needed[word] = None

    visit(body)
    return "with " + ",\n".join(f"{n} as ({steps[n]})" for n in needed) + "\n" + body


def _us(column: str) -> str:
    return f"epoch_us({column})"


_CONFIDENCE_LABEL = """case when confidence >= 80 then 'High'
    when confidence >= 60 then 'Medium' else 'Low' end as confidence_label"""


def _usd(x: str) -> str:
    return f"format('{{:,}}', cast({_r(x, 0)} as bigint))"


def statements() -> dict[str, str]:
    """Query name -> DuckDB statement."""
    s = _statement
    out = {
        "latest_warehouse": s("select * from wh_now"),
        "latest_job": s("select * from jb_now"),
        "state_intervals": s(f"""
            select warehouse_id, {_us('w_start')} as w_start_us, {_us('w_end')} as w_end_us,
                   cluster_count from wh_states"""),
        "on_time": s("""select warehouse_id, cast(on_s as bigint) as on_s,
            cast(cluster_on_s as bigint) as cluster_on_s, max_clusters_observed from wh_on"""),
        "utilized_seconds": s("""select warehouse_id, cast(ifnull(util_s, 0) as bigint) as util_s
            from wh_on left join wh_used using (warehouse_id)"""),
        "query_stats": s(f"""select warehouse_id, query_count,
            cast(p50_task_s as double) as p50_task_s, cast(p95_task_s as double) as p95_task_s,
            {_r('avg_queue_s', 6)} as avg_queue_s, {_r('spill_gb', 6)} as spill_gb
            from wh_load"""),
        "peak_concurrency": s("select * from wh_peak"),
        "warehouse_cost": s(f"""select warehouse_id, {_r('dbus_30d', 4)} as dbus_30d,
            {_r('dollars_30d', 4)} as dollars_30d from wh_spend"""),
        "job_billing": s(f"""select workspace_id, job_id,
            {_r('classic_dbus_30d', 4)} as classic_dbus_30d,
            {_r('serverless_dbus_30d', 4)} as serverless_dbus_30d,
            {_r('classic_dbu_cost_30d', 4)} as classic_dbu_cost_30d from jb_spend"""),
        "warehouse_base": s(f"""select warehouse_id, warehouse_name, warehouse_size,
            warehouse_type, auto_stop_minutes, max_clusters,
            {_r('hours_on', 4)} as hours_on, {_r('hours_utilized', 4)} as hours_utilized,
            {_r('hours_idle', 4)} as hours_idle, util_pct, query_count, peak_concurrent,
            {_r('dollars_30d', 4)} as dollars_30d from wh_base"""),
        "heavy_query_signatures": s(f"""select query_signature, n, cast(ms as bigint) as ms,
            cast(read_b as bigint) as read_b, sample from qt_totals"""),
        "job_run_stats": s(f"""select workspace_id, job_id, run_count_30d,
            {_r('avg_run_minutes', 6)} as avg_run_minutes,
            {_r('p50_run_minutes', 6)} as p50_run_minutes,
            {_r('p95_run_minutes', 6)} as p95_run_minutes,
            {_r('short_run_share_pct', 6)} as short_run_share_pct,
            failed_runs, infra_failure_count, init_script_failure_count from jb_runs"""),
        "job_signals": s(f"""select workspace_id, job_id, job_name, creator_id, run_count_30d,
            {_r('startup_share', 6)} as startup_share, {_r('p95_p50_ratio', 6)} as p95_p50_ratio,
            {_r('failure_rate_pct', 6)} as failure_rate_pct,
            {_r('runs_per_day', 6)} as runs_per_day from jb_signals"""),
        "job_scores": s("select workspace_id, job_id, " + ", ".join(
            f"{_r('score_' + n, 6)} as score_{n}" for n in
            ("duration", "frequency", "startup", "predictability", "infra_failures"))
            + " from jb_scored"),
        "exec_kpis": s(f"""select *, {_r('''(wh_savings_30d
            + 0.3::double * jb_addressable_spend) * 12.0::double''', 2)} as annualized from kpi"""),
        "repeated_statements": s("""select count(*) as repeated_ids, ifnull(sum(n), 0)::bigint as their_rows
            from (select count(*) as n from fx_query_history where statement_id is not null
                  group by statement_id having count(*) > 1)"""),
        "exec_kpis_jobs_only": s(f"""select 0::bigint as wh_count, 0.0::double as wh_savings_30d,
            0.0::double as wh_current_spend_30d, 0::bigint as qt_count, 0.0::double as qt_compute_hours,
            (select count(*) from jb) as jb_count,
            (select count(*) from jb where fit_score >= 70) as jb_high_fit,
            (select ifnull({_r('sum(classic_dbu_cost_30d)', 2)}, 0) from jb) as jb_addressable_spend,
            {_r(f"""0.3::double * (select ifnull({_r('sum(classic_dbu_cost_30d)', 2)}, 0) from jb)
                * 12.0::double""", 2)} as annualized"""),
        "overview_counters": s(f"""select
            (select count(warehouse_id) from wh) as wh_count,
            (select {_r('sum(effective_savings_30d)', 2)} from wh) as wh_savings,
            (select {_r('sum(current_cost_30d)', 2)} from wh) as wh_current,
            (select count(category) from qt) as qt_count,
            (select {_r('sum(compute_hours)', 2)} from qt) as qt_hours,
            (select cast(sum(exec_count) as bigint) from qt) as qt_executions,
            (select count(job_id) from jb) as jb_count,
            (select {_r('sum(classic_dbu_cost_30d)', 2)} from jb) as jb_spend,
            (select cast(sum(run_count_30d) as bigint) from jb) as jb_runs"""),
        "wh_by_category": s(f"""select category, {_r('sum(effective_savings_30d)', 2)} as savings_30d,
            count(distinct warehouse_id) as warehouses, count(*) as findings
            from wh group by category"""),
        "qt_by_category": s(f"""select category,
            {_r('sum(ifnull(total_compute_s, 0)) / 3600.0::double', 2)} as compute_hours,
            count(*) as candidates from qt group by category"""),
        "jb_by_bucket": s(f"""select fit_bucket, count(job_id) as jobs,
            {_r('sum(classic_dbu_cost_30d)', 2)} as classic_dbu_cost_30d,
            {_r('avg(pts_duration)', 2)} as avg_pts_duration from jb group by fit_bucket"""),
        "jb_by_risk": s("""select migration_risk, count(job_id) as jobs
            from jb group by migration_risk"""),
        "top_warehouses": s("""select warehouse_name, category,
            effective_savings_30d as savings_30d, current_cost_30d, utilization_pct,
            recommended_action from wh
            order by effective_savings_30d desc nulls last, warehouse_id limit 10"""),
        "job_fit_vs_spend": s("""select job_name, fit_score, classic_dbu_cost_30d, run_count_30d,
            ifnull(init_script_failure_count, 0) > 0 as has_init_script_risk,
            avg_run_minutes, p95_p50_ratio, top_reasons from jb"""),
        "top_actions": s("""select * from actions
            order by impact_usd_30d desc nulls last, source, category, target, detail limit 50"""),
        "digest_payload": s(f"""select array_to_string(list_filter([
              'Warehouses flagged: ' || (select {_s('count(*)')} from wh)
                || ' | est 30d savings $'
                || (select {_dec('sum(effective_savings_30d)', 0)} from wh),
              'Query/table optimizations: ' || (select {_s('count(*)')} from qt) || ' | '
                || (select {_dec('sum(compute_hours)', 0)} from qt) || ' compute hours',
              'Jobs->serverless candidates: ' || (select {_s('count(*)')} from jb)
                || ' | addressable classic spend $'
                || (select {_dec('sum(classic_dbu_cost_30d)', 0)} from jb),
              '--- Top warehouse actions (confidence 0-100) ---',
              (select lines from wh_lines),
              '--- Top query/table actions (confidence 0-100) ---',
              (select lines from qt_lines),
              '--- Top job candidates (confidence = fit score 0-100) ---',
              (select lines from jb_lines)],
              lambda part: part is not null), chr(10)) as body"""),
        "job_prompt_text": s(f"""select workspace_id, job_id,
            'Job name: ' || job_name || chr(10)
            || 'Avg run duration: ' || {_dec('avg_run_minutes', 1)} || ' min (p50 '
            || {_dec('p50_run_minutes', 1)} || ', p95 ' || {_dec('p95_run_minutes', 1)}
            || ', p95/p50 ratio ' || {_dec('p95_p50_ratio', 2)} || ')' || chr(10)
            || 'Run frequency: ' || {_s('run_count_30d')} || ' runs in 30 days ('
            || {_dec('runs_per_day', 1)} || '/day)' || chr(10)
            || 'Estimated startup overhead: ~' || {_dec('startup_share_pct', 1)}
            || '% of wall-clock per run' || chr(10)
            || 'Failure rate: ' || {_dec('failure_rate_pct', 1)} || '% ('
            || {_s('infra_failure_count')}
            || ' infra-flavored failures: cluster/driver errors)' || chr(10)
            || 'Init-script failures: ' || {_s('init_script_failure_count')}
            || ' (any > 0 may indicate a migration blocker)' || chr(10)
            || 'Classic DBU cost (30d): USD ' || {_dec('classic_dbu_cost_30d', 2)} || chr(10)
            || 'Fit score: ' || {_s('fit_score')} || '/100' || chr(10)
            || 'Detected signals: ' || ifnull(top_reasons, 'none') as prompt_text
            from jb"""),
        "briefing_text": s(f"""select 'Headline KPIs:' || chr(10)
            || '- Identified warehouse savings (30d): $' || {_usd('wh_savings_30d')} || chr(10)
            || '- Annualized projection: $' || {_usd(_r('''(wh_savings_30d
                 + 0.3::double * jb_addressable_spend) * 12.0::double''', 2))} || chr(10)
            || '- Warehouses flagged: ' || {_s('wh_count')} || ' ($'
            || {_usd('wh_current_spend_30d')} || ' current 30d spend)' || chr(10)
            || '- Query/table optimizations: ' || {_s('qt_count')} || ' ('
            || {_usd('qt_compute_hours')} || ' compute hours flagged)' || chr(10)
            || '- Jobs -> serverless: ' || {_s('jb_count')} || ' (' || {_s('jb_high_fit')}
            || ' at >=70 fit, $' || {_usd('jb_addressable_spend')} || ' addressable)'
            || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), (select lines from wh_md),
                 (select lines from qt_md), (select lines from jb_md)) as briefing
            from kpi"""),
        "briefing_subset": s(f"""select 'Headline KPIs:' || chr(10)
            || '- Identified warehouse savings (30d): $' || {_usd('wh_savings_30d')} || chr(10)
            || '- Annualized projection: $' || {_usd(_r('wh_savings_30d * 12.0::double', 2))} || chr(10)
            || '- Warehouses flagged: ' || {_s('wh_count')} || ' ($'
            || {_usd('wh_current_spend_30d')} || ' current 30d spend)' || chr(10)
            || '- Query/table optimizations: 0 (0 compute hours flagged)' || chr(10)
            || '- Jobs -> serverless: 0 (0 at >=70 fit, $0 addressable)'
            || chr(10) || chr(10) || ifnull((select lines from wh_md), '') as briefing
            from kpi"""),
        "wh_table": s(f"select {', '.join(WAREHOUSE_TABLE)} from wh"),
        "qt_table": s(f"select {', '.join(WORKLOAD_TABLE)} from qt"),
        "jb_table": s(f"select {', '.join(JOB_TABLE)} from jb"),
        "wh_confidence": s(f"select warehouse_id, category, confidence, {_CONFIDENCE_LABEL} from wh"),
        "qt_confidence": s(f"""select category, target_or_sample, exec_count, total_compute_s,
            confidence, {_CONFIDENCE_LABEL} from qt"""),
        "stored_findings": s(f"""select workspace_id, job_id, fit_score, classic_dbu_cost_30d, confidence,
            {_CONFIDENCE_LABEL} from jb"""),
        "jb_confidence": s(f"select workspace_id, job_id, confidence, {_CONFIDENCE_LABEL} from jb"),
        "picked_findings": s("""
            select 'warehouse' as source, category as label, warehouse_id as item from wh
            where category in ('DECOMMISSION_CANDIDATE', 'RIGHTSIZE')
            union all select 'query_table', category, target_or_sample from qt
            where category in ('HOT_TABLE_REVIEW', 'HIGH_SPILL_QUERY')
            union all select 'jobs', fit_bucket, job_id from jb
            where fit_bucket in ('60-79 (Good)', '40-59 (Marginal)')
              and migration_risk in ('BLOCKER')"""),
    }
    out["text_fingerprints"] = f"""
        select {_fingerprint('text')} as shape, count(*) as documents,
               min(doc_id) as first_doc_id
        from documents group by 1"""
    lo, day = _ts(RECENT.window_start), f"date '{RECENT.window_start_date}'"
    picks = {
        "warehouses": "fx_warehouses", "jobs": "fx_jobs",
        "warehouse_events": f"fx_warehouse_events where event_time >= {lo}",
        "query_history_all":
            f"fx_query_history where start_time >= {lo} and warehouse_id is not null",
        "query_history_selects": "qt_selects", "query_history_heavy": "qt_heavy",
        "usage_sql": f"fx_usage where usage_start_time >= {lo} and warehouse_id is not null",
        "usage_jobs": f"fx_usage where usage_start_time >= {lo} and job_id is not null"
                      " and billing_origin_product = 'JOBS'",
        "list_prices": "fx_list_prices where currency_code = 'USD'",
        "job_runs":
            f"fx_job_runs where period_start_time >= {lo} and period_end_time is not null",
        "lineage": f"fx_lineage where event_date >= {day} and source_type = 'TABLE'"
                   " and source_table_full_name is not null",
    }
    out["scanned_rows"] = s(" union all ".join(
        f"select '{name}' as selection, count(*) as n from {pick}"
        for name, pick in picks.items()), "recent")
    out["utilized_seconds_sweep"] = out["utilized_seconds"]
    for profile, suffix in (("default", ""), ("tight", "_tight"), ("zero_floor", "_zero_floor")):
        out[f"warehouse_recos{suffix}"] = s("select * from wh_kept", profile)
    for name, step in (("expensive_queries", "qt_expensive"), ("mv_candidates", "qt_repeated"),
                       ("low_pruning", "qt_low_pruning"), ("high_spill", "qt_high_spill"),
                       ("hot_tables", "qt_hot"), ("subsecond_bi", "qt_fast_bi")):
        out[name] = s(f"""select category, selection_criteria, recommended_action, target,
            query_sample, exec_count, total_compute_s, avg_compute_s, avg_spill_gb, pruning_pct,
            total_read_gb from {step} join qt_labels using (category)""")
    out["query_table_recos"] = s("select * from qt_kept")
    out["job_recos"] = s("select * from jb_kept")
    out["warehouse_recos_recent"] = s("select * from wh", "recent")
    out["query_table_recos_recent"] = s("select * from qt", "recent")
    out["job_recos_recent"] = s("select * from jb", "recent")
    return out
