"""State intervals and how much of them queries put to use.

A state log says "from now on N clusters". Consecutive entries of one key bound
a half-open interval; the last entry stays open and has no end.

All durations count whole seconds: both interval ends are floored first. Flooring
is monotone, so clipping and flooring commute and the three formulations below
(interval by interval, block join, running sums) give the same integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellwise.functions import epoch_seconds, once

BLOCK_S = 3600


def _block(seconds: Column, width_s: int) -> Column:
    return F.floor(seconds / F.lit(width_s))


def state_intervals(events: DataFrame, key: str = "warehouse_id",
                    ts: str = "event_time", state: str = "cluster_count",
                    block_s: int = BLOCK_S) -> DataFrame:
    """``key, w_start, w_end, state``: each entry up to the next one of its key.

    The look-ahead runs inside (key, time block) groups, so one very busy key is
    spread over as many groups as the window has blocks. The last entry of a
    block takes the first instant of the key's next block that holds any; that
    second look-ahead sees one row per block only. Entries at the same instant
    are ordered by state.
    """
    log = events.select(key, F.col(ts).alias("w_start"), state,
                        _block(epoch_seconds(F.col(ts)), block_s).alias("_block"))
    within = Window.partitionBy(key, "_block").orderBy("w_start", state)
    across = Window.partitionBy(key).orderBy("_block")
    next_block = (
        log.groupBy(key, "_block").agg(F.min("w_start").alias("_first"))
           .withColumn("_next", F.lead("_first").over(across))
           .drop("_first"))
    return (
        log.withColumn("_end", F.lead("w_start").over(within))
           .join(next_block, [key, "_block"])
           .select(key, "w_start", F.coalesce("_end", "_next").alias("w_end"), state))


def closed_on(intervals: DataFrame, state: str = "cluster_count") -> DataFrame:
    """Intervals that have an end and during which something was running."""
    return intervals.where((F.col(state) > 0) & F.col("w_end").isNotNull())


def on_time(intervals: DataFrame, key: str = "warehouse_id",
            state: str = "cluster_count") -> DataFrame:
    """Seconds on, cluster-seconds on and peak state per key."""
    length = epoch_seconds(F.col("w_end")) - epoch_seconds(F.col("w_start"))
    return closed_on(intervals, state).groupBy(key).agg(
        F.sum(length).alias("on_s"),
        F.sum(length * F.col(state)).alias("cluster_on_s"),
        F.max(state).alias("max_clusters_observed"))


def overlap_seconds_join(intervals: DataFrame, spans: DataFrame,
                         key: str = "warehouse_id", state: str = "cluster_count",
                         block_s: int = BLOCK_S) -> DataFrame:
    """Seconds of overlap per key between running intervals and query spans.

    Literal form: an interval and a span meet when each starts before the other
    ends. Both sides are cut at block borders and equi-joined on (key, block),
    which bounds the pairs per group by one block of time. Prefer
    ``activity``, which forms no pairs at all, unless spans may run backwards.
    """
    def blocks(first: Column, last: Column) -> Column:
        lo, hi = _block(first, block_s), _block(last, block_s)
        # a backwards span is looked up at its end only and never cut
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array(hi)))

    on = closed_on(intervals, state).select(
        key, "w_start", "w_end",
        epoch_seconds(F.col("w_start")).alias("_ws"),
        epoch_seconds(F.col("w_end")).alias("_we"))
    on = on.withColumn("_block", blocks(F.col("_ws"), F.col("_we")))
    used = spans.where("end_time IS NOT NULL").select(
        key, "start_time", "end_time",
        epoch_seconds(F.col("start_time")).alias("_qs"),
        epoch_seconds(F.col("end_time")).alias("_qe"))
    used = used.withColumn("_block", blocks(F.col("_qs"), F.col("_qe")))

    lo = F.col("_block") * F.lit(block_s)
    shared = (F.least("_qe", "_we", lo + F.lit(block_s))
              - F.greatest("_qs", "_ws", lo))
    seconds = F.when(F.col("_qe") < F.col("_qs"), F.col("_qe") - F.col("_qs")) \
               .otherwise(F.greatest(F.lit(0), shared))
    meets = (F.col("start_time") < F.col("w_end")) & (F.col("end_time") > F.col("w_start"))
    return (on.join(used, [key, "_block"]).where(meets)
              .groupBy(key).agg(F.sum(seconds).alias("util_s")))


def _second_states(events: DataFrame, key: str, ts: str, state: str,
                   block_s: int) -> DataFrame:
    """``key, sec, until, clusters, closed``: the last state of each second.

    ``until`` is the next second with an entry, NULL for the last state, which
    stays open. ``closed`` counts the running intervals that begin in the second
    and have an end, including those that end within it. Of entries at one
    instant the greatest state counts as the last.

    The log is dealt by (key, time block) once; the sums and the look-ahead run
    inside these groups. A block's last second takes the first second of the
    key's next block, from one row per block.
    """
    zero = F.lit(0).cast("bigint")
    at = F.col(ts).cast("timestamp")
    # As a struct a NULL key equals itself, so the look-ahead joins on the partitioning at hand.
    # An entry without an instant has no second; left out here, both readers want the same rows.
    log = once(events.select(
        F.struct(key).alias("_key"), epoch_seconds(F.col(ts)).alias("sec"), F.unix_micros(at).alias("_us"),
        F.greatest(F.coalesce(state, zero), zero).alias("_state"),
        (F.col(state) > 0).alias("_on"),
    ).withColumn("_block", _block(F.col("sec"), block_s)).where("_block IS NOT NULL"), "_key", "_block")
    states = (
        log.groupBy("_key", "_block", "sec", "_us")
           .agg(F.max("_state").alias("_state"), F.count_if("_on").alias("running"))
           .groupBy("_key", "_block", "sec")
           .agg(F.max_by("_state", "_us").alias("clusters"), F.sum("running").alias("running")))
    within = Window.partitionBy("_key", "_block").orderBy("sec")
    next_block = (
        log.groupBy("_key", "_block").agg(F.min("sec").alias("_first"))
           .select("_key", "_block", F.lead("_first").over(
               Window.partitionBy("_key").orderBy("_block")).alias("_next")))
    ahead = (
        states.withColumn("_until", F.lead("sec").over(within))
              .join(next_block, ["_key", "_block"])
              .withColumn("until", F.coalesce("_until", "_next")))
    still_open = F.col("until").isNull() & (F.col("clusters") > 0)
    return ahead.select(F.col(f"_key.{key}").alias(key), "sec", "until", "clusters",
                        (F.col("running") - still_open.cast("bigint")).alias("closed"))


def activity(events: DataFrame, spans: DataFrame, key: str = "warehouse_id",
             ts: str = "event_time", state: str = "cluster_count",
             block_s: int = BLOCK_S) -> DataFrame:
    """On-time, used seconds and peak starts per minute from logs and spans at once.

    ``key, on_s, cluster_on_s, util_s, peak_concurrent`` with ``on_s`` NULL for a
    key without a closed running interval and ``peak_concurrent`` NULL for a key
    without spans. A key with neither has no row. ``block_s`` must hold whole
    minutes.

    With C(t) the seconds a key has been on before t, the used seconds are the
    sum of C(end) - C(start) over its spans. Only the last state of a second and
    the spans starting and ending in it matter. Both are marks on a second, which
    are dealt by (key, time block) in one shuffle; a busy key is spread over as many
    groups as the window has blocks.

    Within a block, C is its value at the block's start, plus the time since then
    if the key was already on, plus what running sums over the block's interval
    borders add. Weighing all three by the span ends needs only sums per block;
    the first two factors follow from running sums over the blocks of the key.

    Spans that overlap each other count each. A span that ends before it starts
    counts negatively if both its ends lie in one running interval, else not at
    all; such spans are faults of the source, so they take the way of
    ``overlap_seconds_join``, and the log is read for them only if there are any.
    """
    if block_s <= 0 or block_s % 60:
        raise ValueError(f"block_s must be whole minutes, not {block_s} s")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = ("opens", "clusters", "closed", "starts", "ends")

    def dealt(rows: DataFrame, first: Column, last: Column, **counts: Column) -> DataFrame:
        """A row for both marks of a row if they lie in one block, else a row for each. A NULL
        ``last`` has no mark."""
        first_block, last_block = _block(first, block_s), _block(last, block_s)
        none = F.lit(None).cast("bigint")

        def piece(block: Column, has_first: bool, second: Column) -> Column:
            return F.struct(F.col(key), block.alias("block"), F.lit(has_first).alias("has_first"), (first if has_first else none).alias("first"),
                            second.alias("last"), *[counts.get(m, zero).alias(m) for m in marks])

        # The key comes out of the generator as well: a filter on it would tell the readers of the log apart.
        return rows.select(F.inline(
            F.when(last.isNull(), F.array(piece(first_block, True, none)))
             .when(first_block == last_block, F.array(piece(first_block, True, last)))
             .otherwise(F.array(piece(first_block, True, none), piece(last_block, False, last)))))

    on = ((F.col("clusters") > 0) & F.col("until").isNotNull()).cast("bigint")
    borders = dealt(_second_states(events, key, ts, state, block_s).where("closed > 0"), F.col("sec"),
                    F.when(on > 0, F.col("until")), opens=on, clusters=on * F.col("clusters"), closed=F.col("closed"))

    begun, ended = epoch_seconds(F.col("start_time")), epoch_seconds(F.col("end_time"))
    backward = F.col("end_time") < F.col("start_time")
    # a span without an end, or with one before its start, is a start that weighs nothing
    has_end = ended.isNotNull() & ~F.coalesce(backward, F.lit(False))
    span_ends = dealt(spans, begun, F.when(has_end, ended), starts=one, ends=has_end.cast("bigint"))

    # What moves is narrow; marks are taken apart, and their products formed, behind the shuffle.
    start = F.col("block") * F.lit(block_s)
    halves = F.array(
        F.struct(F.col("has_first").alias("here"), (F.col("first") - start).alias("rel"), "opens", "clusters", "closed",
                 "starts", (-F.col("ends")).alias("ends")),
        F.struct(F.col("last").isNotNull().alias("here"), (F.col("last") - start).alias("rel"), (-F.col("opens")).alias("opens"),
                 (-F.col("clusters")).alias("clusters"), zero.alias("closed"), zero.alias("starts"), F.col("ends").alias("ends")))
    placed = (borders.unionByName(span_ends).repartition(key, "block").select(key, "block", F.inline(halves)).where("here")
                     .withColumn("minute", F.floor(F.col("rel") / 60)))
    rel, opens, ends = F.col("rel"), F.col("opens"), F.col("ends")
    # a range takes in all marks of a second, in whatever order they come; one sort serves both windows
    in_block = Window.partitionBy(key, "block").orderBy("minute", "rel").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    in_minute = F.sum("starts").over(Window.partitionBy(key, "block", "minute"))
    on_since_start = rel * F.sum("opens").over(in_block) - F.sum(opens * rel).over(in_block)
    sums = ("opens", "opens_rel", "clusters", "clusters_rel", "closed", "ends", "ends_rel",
            "inner")
    per_block = placed.select(
        key, "block", in_minute.alias("starts"),
        "opens", (opens * rel).alias("opens_rel"),
        "clusters", (F.col("clusters") * rel).alias("clusters_rel"), "closed",
        "ends", (ends * rel).alias("ends_rel"), (ends * on_since_start).alias("inner"),
    ).groupBy(key, "block").agg(
        F.max("starts").alias("peak"), *[F.sum(c).alias(c) for c in sums])

    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    opened_at = opens * start + F.col("opens_rel")
    was_on = F.coalesce(F.sum("opens").over(earlier), zero)
    on_before = start * was_on - F.coalesce(F.sum(opened_at).over(earlier), zero)
    has_intervals = F.sum("closed") > 0
    forward = per_block.select(
        key, "closed", "peak", (-opened_at).alias("on_s"),
        (-(F.col("clusters") * start + F.col("clusters_rel"))).alias("cluster_on_s"),
        (ends * on_before + F.col("ends_rel") * was_on + F.col("inner")).alias("used"),
    ).groupBy(key).agg(
        F.when(has_intervals, F.sum("on_s")).alias("on_s"),
        F.when(has_intervals, F.sum("cluster_on_s")).alias("cluster_on_s"),
        F.sum("used").alias("util_s"),
        F.max(F.when(F.col("peak") > 0, F.col("peak"))).alias("peak_concurrent"))
    faults = spans.where(backward)
    taken_back = overlap_seconds_join(
        state_intervals(events.where(faults.exists()), key, ts, state, block_s), faults, key, state,
        block_s).select(F.col(key).alias("_key"), F.col("util_s").alias("_back"))
    return (forward.join(taken_back, F.col(key).eqNullSafe(F.col("_key")), "left")
                   .select(key, "on_s", "cluster_on_s",
                           (F.col("util_s") + F.coalesce("_back", zero)).alias("util_s"),
                           "peak_concurrent"))


def overlap_seconds(events: DataFrame, spans: DataFrame, key: str = "warehouse_id",
                    method: str = "sweep") -> DataFrame:
    """``key, util_s`` by running sums ("sweep") or by block join ("join")."""
    if method == "sweep":
        return activity(events, spans, key).select(key, "util_s")
    if method == "join":
        return overlap_seconds_join(state_intervals(events, key), spans, key)
    raise ValueError(f"unknown method {method!r}; valid: ['join', 'sweep']")


def peak_per_bucket(df: DataFrame, key: str, ts: str, bucket_s: int = 60) -> DataFrame:
    """Most rows of a key that start within one bucket of time."""
    bucket = F.floor(epoch_seconds(F.col(ts)) / F.lit(bucket_s)).alias("_bucket")
    return (df.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(key).agg(F.max("_n").alias("peak_concurrent")))
