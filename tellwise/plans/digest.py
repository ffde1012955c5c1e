"""Text payloads: headline figures and leading findings for a summary writer.

The texts are data. Nothing here calls a model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellwise.functions import decimal_text, half_up, once
from tellwise.plans.labels import (
    BRIEFING_HEAD, BRIEFING_KPIS, BRIEFING_TITLES, DIGEST_JOBS, DIGEST_WAREHOUSES, DIGEST_WORKLOADS,
)
from tellwise.plans.rollups import exec_kpis, whole_row

DIGEST_TOP = 5
BRIEFING_TOP = 10


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _leading_lines(findings: DataFrame, line: Column, order: Sequence[tuple[str, bool]],
                   n: int, name: str) -> DataFrame:
    """One row with the lines of the n leading findings, in order.

    ``order`` lists (column, descending); only the n survivors are gathered.
    """
    keys = [F.col(c).desc_nulls_last() if down else F.col(c) for c, down in order]
    rank = [(F.coalesce(-F.col(c), F.lit(float("inf"))) if down else F.col(c)).alias(f"k{i}")
            for i, (c, down) in enumerate(order)]
    leading = findings.orderBy(*keys).limit(n).select(F.struct(*rank, line.alias("line")).alias("r"))
    ordered = F.array_sort(F.collect_list("r"))
    return (leading.where("r.line IS NOT NULL")
                   .agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias(name)))


def digest_payload(warehouses: DataFrame | None, workloads: DataFrame | None,
                   jobs: DataFrame | None, n: int = DIGEST_TOP) -> DataFrame:
    """One row, one text: counts and totals, then the leading findings per set.

    A total over no rows is NULL and its line is left out; so are the lines of a set
    that was not selected.
    """
    def whole(column: str | Column) -> Column:
        return decimal_text(F.col(column) if isinstance(column, str) else column, 0)

    count = F.count(F.lit(1))
    parts, figures, sections = [], [], []
    if warehouses is not None:
        findings = once(warehouses, "category")
        parts += [
            findings.agg(count.alias("wh_count"), whole(F.sum("effective_savings_30d")).alias("wh_savings")),
            _leading_lines(
                findings,
                _text("- ", F.col("warehouse_name"), " [", F.col("category"), "] save $",
                      whole("effective_savings_30d"), ", confidence ", F.col("confidence"),
                      ": ", F.col("recommended_action")),
                [("effective_savings_30d", True), ("warehouse_id", False)], n, "wh_lines")]
        figures.append(_text(DIGEST_WAREHOUSES[0], F.col("wh_count"), DIGEST_WAREHOUSES[1], F.col("wh_savings")))
        sections += [F.lit(DIGEST_WAREHOUSES[2]), F.col("wh_lines")]
    if workloads is not None:
        findings = once(workloads, "category")
        parts += [
            findings.agg(count.alias("qt_count"), whole(F.sum("compute_hours")).alias("qt_hours")),
            _leading_lines(
                findings,
                _text("- [", F.col("category"), "] confidence ", F.col("confidence"), ": ",
                      F.col("recommended_action")),
                [("total_compute_s", True), ("category", False), ("target_or_sample", False),
                 ("recommended_action", False)],
                n, "qt_lines")]
        figures.append(_text(DIGEST_WORKLOADS[0], F.col("qt_count"), " | ", F.col("qt_hours"), DIGEST_WORKLOADS[1]))
        sections += [F.lit(DIGEST_WORKLOADS[2]), F.col("qt_lines")]
    if jobs is not None:
        findings = once(jobs, "job_id")
        parts += [
            findings.agg(count.alias("jb_count"), whole(F.sum("classic_dbu_cost_30d")).alias("jb_spend")),
            _leading_lines(
                findings,
                _text("- ", F.col("job_name"), " fit ", F.col("fit_score"), "/100, $",
                      whole("classic_dbu_cost_30d"), ": ", F.coalesce("top_reasons", F.lit(""))),
                [("fit_score", True), ("classic_dbu_cost_30d", True),
                 ("workspace_id", False), ("job_id", False)], n, "jb_lines")]
        figures.append(_text(DIGEST_JOBS[0], F.col("jb_count"), DIGEST_JOBS[1], F.col("jb_spend")))
        sections += [F.lit(DIGEST_JOBS[2]), F.col("jb_lines")]
    return whole_row(parts).select(F.concat_ws("\n", *figures, *sections).alias("body"))


def _markdown(findings: DataFrame, order: Sequence[tuple[str, bool]],
              n: int, name: str, title: str) -> DataFrame:
    """One row with a titled Markdown table of the n leading findings and all their columns,
    NULL without any. Bars are escaped and line breaks become blanks, so a cell stays a cell;
    fractional numbers have two decimals."""
    columns = findings.columns

    def cell(column: str) -> Column:
        fraction = isinstance(findings.schema[column].dataType, T.FractionalType)
        text = decimal_text(F.col(column), 2) if fraction else F.col(column).cast("string")
        text = F.coalesce(text, F.lit(""))
        return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    body = _leading_lines(findings, line, order, n, name)
    return body.select(F.when(F.col(name) != "", F.concat(F.lit(f"## {title}\n{head}"), F.col(name))).alias(name))


def briefing_text(warehouses: DataFrame | None, workloads: DataFrame | None,
                  jobs: DataFrame | None, n: int = BRIEFING_TOP) -> DataFrame:
    """One row, one text: headline KPIs, then a table of leading findings per set.

    A set without rows, or not selected, counts as zero and has no section.
    """
    def money(column: str) -> Column:
        return F.format_number(half_up(F.col(column), 0).cast("bigint"), 0)

    sets = {
        "wh_lines": (warehouses, ("category",), BRIEFING_TITLES[0],
                     [("effective_savings_30d", True), ("warehouse_id", False)]),
        "qt_lines": (workloads, ("category",), BRIEFING_TITLES[1],
                     [("total_compute_s", True), ("category", False), ("target_or_sample", False),
                      ("recommended_action", False)]),
        "jb_lines": (jobs, ("job_id",), BRIEFING_TITLES[2],
                     [("fit_score", True), ("workspace_id", False), ("job_id", False)]),
    }
    held = {name: once(df, *keys) for name, (df, keys, *_) in sets.items() if df is not None}
    tables = [_markdown(df, sets[name][3], n, name, sets[name][2])
              for name, df in held.items()]
    row = whole_row([exec_kpis(*(held.get(name) for name in sets)), *tables])
    kpis = F.concat_ws(
        "\n",
        _text(BRIEFING_KPIS[0], money("wh_savings_30d")),
        _text(BRIEFING_KPIS[1], money("annualized")),
        _text(BRIEFING_KPIS[2], F.col("wh_count"), " ($",
              money("wh_current_spend_30d"), BRIEFING_KPIS[3]),
        _text(BRIEFING_KPIS[4], F.col("qt_count"), " (",
              money("qt_compute_hours"), BRIEFING_KPIS[5]),
        _text(BRIEFING_KPIS[6], F.col("jb_count"), " (", F.col("jb_high_fit"),
              BRIEFING_KPIS[7], money("jb_addressable_spend"), BRIEFING_KPIS[8]))
    sections = F.concat_ws("\n\n", *(F.col(name) for name in held))
    return row.select(F.concat(F.lit(BRIEFING_HEAD), kpis, F.lit("\n\n"), sections).alias("briefing"))
