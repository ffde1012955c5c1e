"""Hard negatives for an embedding model by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive opens a window of scores below
its own, from which the best rows of other labels are wanted. The windows of an anchor overlap, but
their upper limits, in descending order, cut the scores into disjoint slots. A row belongs to one slot, so
a task keeps the best k rows of each slot and of no window; slots of all tasks are merged the same way.
What a window holds of the best rows below its upper limit are then the first k rows of its slot and
the slots after it, read in descending order; its lower limit cuts off their tail.

Scores of anchors against all rows are computed in cells, blocks of rows against blocks of anchors:
rows and anchors are dealt into blocks of bounded size by hash, each row is sent once for each block of
anchors, each anchor once for each block of rows. Only the best rows leave a cell.

Scores are whole numbers. They come from floating-point products where these are exact (sums below
2 ** 53) and from Python's integers elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellwise.llm.base import quoted, settled

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is 30 to 90 hundredths of the positive's.
LOW, HIGH, OF = 30, 90, 100
SCALE = 256
ROW_BLOCK, ANCHOR_BLOCK = 32_768, 2_048
#: Scores beyond are held at this, so that limits can be computed on longs.
_MOST = 9 * 10 ** 16
_CHUNK = 1 << 22


def prepared(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vector: array of double) of the rows that take part, one for each vec_id."""
    vector = quoted(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & vector.isNotNull() & finite)
    rows = rows.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("long").alias("label"), vector.alias("vector"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("row.label") + 1) % 10).otherwise(F.col("row.label"))
    return one.select("vec_id", label.alias("label"), F.col("row.vector").alias("vector"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of vectors as rows, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    lengths = column.combine_chunks().value_lengths()
    return max(lengths.to_pylist(), default=0)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (int64) of whole-numbered vectors, anchors by rows; exact."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2 ** 53:
        return (anchors @ rows.T).astype(np.int64)
    def whole(x: np.ndarray) -> np.ndarray:
        return np.array([[int(v) if np.isfinite(v) else int(np.sign(v)) * 10 ** 320 for v in r] for r in x], dtype=object).reshape(x.shape)

    return np.clip(whole(anchors) @ whole(rows).T, -_MOST, _MOST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, choose: Callable, schema: str) -> DataFrame:
    """choose over each cell: a block of rows (vec_id, label, vector) and a block of anchors (those
    and more columns), as Arrow tables."""
    by_rows, by_anchors = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))

    def dealt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long"))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    left = rows.select("vec_id", "label", "vector", dealt(by_rows).alias("r"), every(by_anchors).alias("a"))
    right = anchors.select(*(F.col(c).alias(c) for c in anchors.columns), every(by_rows).alias("r"), dealt(by_anchors).alias("a"))
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(choose, schema)


def _each(rows: pa.Table, anchors: pa.Table):
    """(place of the anchor, scores of all rows) for each anchor of a cell, computed chunk by chunk."""
    if not len(rows) or not len(anchors):
        return
    width = max(_width(rows["vector"]), _width(anchors["vector"]))
    left, right = _matrix(anchors["vector"], width), _matrix(rows["vector"], width)
    step = max(1, _CHUNK // len(rows))
    for start in range(0, len(left), step):
        for at, row in enumerate(scores(left[start:start + step], right)):
            yield start + at, row


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def _out(columns: dict[str, list]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()) for name, parts in columns.items()})


def positives_of(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positives): the first k other rows of each anchor's label, as an array of (score,
    vec_id) in descending order; anchors with none are left out."""
    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = _numbers(left, "vec_id"), _numbers(left, "label")
        own, mine = _numbers(right, "vec_id"), _numbers(right, "label")
        out = {"anchor_id": [], "vec_id": [], "score": []}
        for at, score in _each(left, right):
            same = np.flatnonzero((labels == mine[at]) & (ids != own[at]))
            chosen = same[best(score[same], ids[same], k)]
            out["anchor_id"].append(np.full(len(chosen), own[at]))
            out["vec_id"].append(ids[chosen])
            out["score"].append(score[chosen])
        return _out(out)

    found = _cells(rows, anchors, n_rows, n_anchors, choose, "anchor_id long, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    listed = found.withColumn("rank", first).where(F.col("rank") <= k).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("listed"))
    return listed.select("anchor_id", F.transform("listed", lambda p: F.struct(p["score"].alias("score"), p["vec_id"].alias("vec_id"))).alias("positives"))


def limits(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of the windows of positives with these scores."""
    return -((-LOW * score) // OF), (HIGH * score) // OF


def slots_of(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int = NEGATIVES) -> DataFrame:
    """(anchor_id, slot, vec_id, score): of each slot of an anchor (with `positives`) the first k rows of
    other labels. Slot i holds the scores from the upper limit of positive i + 1 (not included) to
    that of positive i; the last one ends at the least lower limit of all."""
    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = _numbers(left, "vec_id"), _numbers(left, "label")
        own, mine = _numbers(right, "vec_id"), _numbers(right, "label")
        scored = [np.array([p["score"] for p in ps], np.int64) for ps in right["positives"].to_pylist()]
        out = {"anchor_id": [], "slot": [], "vec_id": [], "score": []}
        for at, score in _each(left, right):
            lower, upper = limits(scored[at])
            ends = np.append(upper[1:], lower.min() - 1)
            near = np.flatnonzero((labels != mine[at]) & (score <= upper[0]) & (score >= lower.min()))
            near_score, near_ids = score[near], ids[near]
            for slot, (low, high) in enumerate(zip(ends, upper)):
                inside = np.flatnonzero((near_score > low) & (near_score <= high))
                chosen = inside[best(near_score[inside], near_ids[inside], k)]
                out["anchor_id"].append(np.full(len(chosen), own[at]))
                out["slot"].append(np.full(len(chosen), slot))
                out["vec_id"].append(near_ids[chosen])
                out["score"].append(near_score[chosen])
        return _out(out)

    found = _cells(rows, anchors, n_rows, n_anchors, choose, "anchor_id long, slot long, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", first).where(F.col("rank") <= k).drop("rank")


def windows_of(slots: DataFrame, positives: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's window,
    answered by the slots from its own on."""
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("below"), "vec_id"))).alias("slots"))
    each = positives.join(merged, "anchor_id").select("anchor_id", "slots", F.posexplode("positives").alias("slot", "positive"))
    # Slots and the scores in them descend, so a window's answer is one stretch of the list.
    suffix = F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("slot")), 1, k)
    inside = F.filter(suffix, lambda s: -s["below"] * OF >= LOW * F.col("positive.score"))
    rows = each.select("anchor_id", "positive", F.posexplode(inside).alias("at", "negative"))
    return rows.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
                       F.col("positive.score").alias("positive_score"), (-F.col("negative.below")).alias("negative_score"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The first negatives of every (anchor, positive): anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; all rows are searched. Rows with a null id,
    label, vector or component, or a component that is not finite, take no part. Of rows with one id,
    the one with the least (label, vector) takes part, so rows that repeat whole count once. Vectors of
    different lengths are compared as if the shorter one went on with zeros; an empty vector scores 0.
    Ties go to the smaller id. Scores beyond 9 * 10 ** 16 count as that. A positive without negatives in
    its window has no rows. Other columns are not read; an empty table gives no rows.
    """
    rows = settled(prepared(vectors, id_col, label_col, vector_col))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    found = settled(positives_of(rows, anchors, n_rows, n_anchors, positives))
    known = anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    slots = slots_of(rows, known, n_rows, n_anchors, negatives)
    return windows_of(slots, found, negatives)
