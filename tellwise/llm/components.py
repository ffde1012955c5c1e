"""Connected components of a graph in a table, by repeated contraction.

In each round every vertex moves to the smallest of its neighbours and itself, and on to where that one
moves, in an order that a new pseudo-random number gives each round; edges follow their ends, and edges inside one vertex go. So
the graph shrinks to a fraction each round, whatever its shape. Only sums by vertex and joins on
vertices are used; a vertex with a third of all edges is combined before it is shuffled, and the join
on it can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import settled

#: Edges of a graph that is worked on in one partition (16 bytes each).
SMALL = 200_000

_MASKS = (0x5DEECE66D1CE4E5B, 0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x7C1592DA5B8E64F3)


def _mask(turn: int) -> int:
    return (_MASKS[turn % len(_MASKS)] * (2 * (turn // len(_MASKS)) + 1)) & 0x7FFFFFFFFFFFFFFF


def _together(df: DataFrame) -> DataFrame:
    """A table of bounded size in one partition, so that sums and joins of such tables need no
    shuffles (each would have as many tasks as there are shuffle partitions); others as they are."""
    return df.coalesce(1) if df.count() <= SMALL else df


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (a, b: long): vertices of one component have the same
    root, its smallest id. Edges may repeat and have any direction; loops count for nothing; a null
    end drops the edge. No edges give no rows. Ids should be spread like hash values."""
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = settled(ordered.distinct())
    moves: list[DataFrame] = []
    while n := left.count():
        # A graph of bounded size needs no shuffles: one partition holds it.
        left = left.coalesce(1) if n <= SMALL else left
        mask = F.lit(_mask(len(moves)))
        both = left.select("a", "b").union(left.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("least"))
        hop = nearest.select(F.col("a").alias("id"), F.least("least", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))
        # Two hops in a round: to where the smallest neighbour itself moves.
        onward = hop.select(F.col("id").alias("to"), F.col("to").alias("next"))
        move = settled(hop.join(onward, "to").select("id", F.col("next").alias("to")))
        moves.append(move)
        moved = (left.join(move.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a")
                 .join(move.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2"))
        left = settled(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # Each vertex moves once in the first round, and fewer do in each later one.
    labels = _together(moves[0])
    for move in moves[1:]:
        step = _together(move).select(F.col("id").alias("to"), F.col("to").alias("next"))
        labels = labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    labels = _together(settled(labels)) if len(moves) > 1 else labels
    smallest = labels.groupBy("to").agg(F.min("id").alias("root"))
    return labels.join(smallest, "to").select("id", "root")


def merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes (id, root; settled) of a graph, with more edges (a, b; settled) added to it."""
    classes, edges = _together(classes), _together(edges)

    def end(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))

    lifted = (edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
              .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = _together(settled(components(lifted)))
    to = moved.select(F.col("id").alias("root"), F.col("root").alias("new"))
    old = classes.join(to, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return settled(old.union(moved.join(classes, "id", "left_anti").select("id", "root")))
