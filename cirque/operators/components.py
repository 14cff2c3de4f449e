"""Connected components by randomised contraction, with DataFrame operations only.

Each round gives every node the neighbour (or itself) with the smallest random
rank and contracts the edges onto those representatives; the ranks are new in
every round, so the number of nodes that still have edges falls by a constant
factor on any graph (long chains too) and there are O(log n) rounds. A node of
any degree is handled by partial aggregation; no group is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs, any order, repeats allowed -> (node, component): the smallest node it reaches.

    Only nodes with an edge to another node appear. Empty edges give an empty result.
    """
    live = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"
    )
    steps: list[DataFrame] = []
    while not live.isEmpty():
        seed = F.lit(len(steps) + 1)
        rank = lambda c: F.xxhash64(c, seed)  # noqa: B023, E731
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        step = materialise(
            best.select(F.col("a").alias("node"), F.when(rank("a") <= F.col("m.r"), F.col("a")).otherwise(F.col("m.n")).alias("to")),
            "cc-step",
        )
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b").where("ta <> tb")
        live = materialise(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        steps.append(step)
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        up = labels.select(F.col("node").alias("to"), F.col("to").alias("top"))
        labels = step.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
    labels = materialise(labels, "cc-labels")
    least = labels.groupBy("to").agg(F.min(F.least("node", "to")).alias("component"))
    return labels.join(least, "to").select("node", "component")
