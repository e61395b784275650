"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmill.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each edge end's component. ``edges`` has a, b (long).

    Each round every node moves to the one of smallest hash among itself and its
    neighbours, and edges follow; those that become loops go. The hash changes from round
    to round, so edges shrink by a constant share whatever the graph's shape and its
    numbering, and rounds grow with the logarithm of its size. The moves are then chained
    from the last to the first. All tables are written to ``scratch``; a hub is combined
    before the shuffle where neighbours are taken, and split like any skewed key in joins.
    """
    live = scratch.table(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    every = live.select("a").union(live.select("b")).distinct()
    moves: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c, turn=len(moves): F.xxhash64(F.lit(turn), c)
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("least"))
        moves.append(scratch.table(near.select(F.col("a").alias("node"), F.when(F.col("least") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to"))))
        x, y = (moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = live.join(x, "a").join(y, "b").filter("a_to != b_to")
        live = scratch.table(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not moves:
        return scratch.table(every.select(F.col("a").alias("node"), F.col("a").alias("label")))
    end = moves.pop()
    while moves:
        last = end.select(F.col("node").alias("to"), F.col("to").alias("end"))
        end = scratch.table(moves.pop().join(last, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    smallest = scratch.table(end.groupBy("to").agg(F.min("node").alias("label")))
    return scratch.table(end.join(smallest, "to").select("node", "label"))
