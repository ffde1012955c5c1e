"""Query signatures, table reads and warehouse traffic from the query history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellwise.config import Thresholds
from tellwise.functions import fingerprint
from tellwise.operators.quantiles import summarise
from tellwise.sources.scans import finished_selects, table_edges

SAMPLE_CHARS = 300
HEAVY_FACTS = ("total_task_duration_ms", "read_bytes", "pruned_files_bytes",
               "spilled_local_bytes")


def heavy_queries(query_history: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Finished SELECTs above the duration floor, with fingerprint and text sample.

    Statement ids identify a statement, so one scan carries every column; rows
    without one are left out. The whole text is fingerprinted here and goes no
    further.
    """
    return (
        finished_selects(query_history, cfg=cfg)
        .where((F.col("total_task_duration_ms") > cfg.min_query_duration_s * 1000)
               & F.col("statement_text").isNotNull()
               & F.col("statement_id").isNotNull())
        .select("statement_id", *HEAVY_FACTS,
                fingerprint(F.col("statement_text")).alias("query_signature"),
                F.substring("statement_text", 1, SAMPLE_CHARS).alias("sample")))


def shared_by_statement(heavy: DataFrame) -> DataFrame:
    """The same rows, shuffled by statement id in a form all readers can reuse.

    Statement texts are most of a query history. Two readers that need different
    columns would each scan them; behind the generator both need the same
    shuffle, so Spark computes it once. Heavy statements are few and narrow next
    to the history, and a join on the statement id needs no further shuffle.
    """
    others = [c for c in heavy.columns if c != "statement_id"]
    return heavy.repartition("statement_id").select(
        "statement_id", F.inline(F.array(F.struct(*others))))


def signature_rollup(heavy: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """One row per signature with the totals every signature detector needs.

    ``big_*`` cover executions reading at least the pruning floor, ``spill_*``
    those that spilled. Samples keep the least text of their subset: the least
    300-character prefix is the prefix of the least text.
    """
    ms, read = F.col("total_task_duration_ms"), F.col("read_bytes")
    pruned, spilled = F.col("pruned_files_bytes"), F.col("spilled_local_bytes")
    sample = F.col("sample")
    big = read >= F.lit(cfg.pruning_min_read_gb * 1024.0 ** 3)
    spills = spilled > 0
    return heavy.groupBy("query_signature").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ms).alias("ms"),
        F.sum(read).alias("read_b"),
        F.min(sample).alias("sample"),
        F.count_if(big).alias("big_n"),
        F.sum(F.when(big, ms)).alias("big_ms"),
        F.sum(F.when(big, read)).alias("big_read_b"),
        F.sum(F.when(big, pruned)).alias("big_pruned_b"),
        F.min(F.when(big, sample)).alias("big_sample"),
        F.count_if(spills).alias("spill_n"),
        F.sum(F.when(spills, ms)).alias("spill_ms"),
        F.sum(F.when(spills, spilled)).alias("spill_b"),
        F.min(F.when(spills, sample)).alias("spill_sample"))


def table_reads(lineage: DataFrame, heavy: DataFrame, *, cfg: Thresholds) -> DataFrame:
    """Distinct readers and heavy-query totals per source table.

    Repeated lineage edges weigh the sums but not the distinct counts. Edges are
    collapsed with their multiplicity before the join, so neither a much-read
    table nor a statement with many edges travels as raw rows. Edges without an
    entity can match no statement and only count for users, so they stay out of
    the join. A table whose edges name neither an entity nor a user has no row.
    """
    edges = table_edges(lineage, cfg=cfg)
    table = "source_table_full_name"
    reads = (edges.where("entity_id IS NOT NULL").groupBy(table, "entity_id")
                  .agg(F.count(F.lit(1)).alias("_edges")))
    weights = heavy.select(
        F.col("statement_id").alias("entity_id"), "total_task_duration_ms",
        "read_bytes", "spilled_local_bytes")

    def weighted(column: str):
        return F.sum(F.col(column) * F.col("_edges"))

    # The collapsed edges are unique by entity until the join; a statement that
    # is in the history twice weighs twice but reads once.
    per_entity = (reads.join(weights, "entity_id", "left").groupBy(table, "entity_id").agg(
        weighted("total_task_duration_ms").alias("ms"),
        weighted("spilled_local_bytes").alias("spill_b"), weighted("read_bytes").alias("read_b")))
    read = per_entity.groupBy(table).agg(
        F.count(F.lit(1)).alias("readers"), *[F.sum(c).alias(c) for c in ("ms", "spill_b", "read_b")])
    used = (edges.where("created_by IS NOT NULL").select(table, "created_by").distinct()
                 .groupBy(table).agg(F.count(F.lit(1)).alias("users")))
    same = F.col(f"r.{table}").eqNullSafe(F.col(f"u.{table}"))
    none = F.lit(0).cast("bigint")
    return read.alias("r").join(used.alias("u"), same, "full").select(
        F.coalesce(f"r.{table}", f"u.{table}").alias(table), F.coalesce("readers", none).alias("readers"),
        F.coalesce("users", none).alias("users"), "ms", "spill_b", "read_b")


def repeated_statements(query_history: DataFrame) -> DataFrame:
    """One row: how many statement ids the history holds more than once, and how many
    rows have them. Statement ids are taken to be unique everywhere else; a history
    row delivered twice counts twice."""
    return (query_history.where("statement_id IS NOT NULL").groupBy("statement_id")
                         .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                         .agg(F.count(F.lit(1)).alias("repeated_ids"),
                              F.coalesce(F.sum("n"), F.lit(0)).alias("their_rows")))


def require_unique_statements(query_history: DataFrame) -> None:
    """Raise ValueError if a statement id occurs twice."""
    found = repeated_statements(query_history).first()
    if found["repeated_ids"]:
        raise ValueError(f"{found['repeated_ids']} statement ids occur on {found['their_rows']} rows")


def warehouse_traffic(selects: DataFrame) -> DataFrame:
    """Volume, users and task-time percentiles of finished SELECTs per warehouse.

    Statements without a warehouse form a group of their own.
    """
    by_duration = selects.groupBy("warehouse_id", "total_task_duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum("read_bytes").alias("read_b"))
    ms, n = F.col("total_task_duration_ms"), F.col("n")
    pace = summarise(
        by_duration, ["warehouse_id"], value="total_task_duration_ms", weight="n",
        percents={"p50_ms": 50, "p95_ms": 95},
        sums={"n": n, "ms": ms * n, "timed": F.when(ms.isNotNull(), n), "read_b": F.col("read_b")})
    users = (selects.select("warehouse_id", "executed_by").distinct()
                    .groupBy("warehouse_id").agg(F.count("executed_by").alias("users")))
    same = F.col("pace.warehouse_id").eqNullSafe(F.col("users.warehouse_id"))
    return pace.alias("pace").join(users.alias("users"), same).select(
        F.col("pace.warehouse_id"), "n", F.col("users.users"), "ms", "timed", "read_b",
        (F.col("p50_ms") / F.lit(1000.0)).alias("p50_s"),
        (F.col("p95_ms") / F.lit(1000.0)).alias("p95_s"))
