"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); each component has one root, one of its nodes.

    In each round every node hooks onto its least neighbour if that is less, by a hash that changes with the
    round; edges are then redrawn between the nodes hooked onto and repeated ones fall away. The number of
    nodes shrinks by a constant factor on average, a star or a clique takes one or two rounds, and nothing is
    collected but the number of edges left. Nodes must not be null.
    """
    rest = materialize(_plain(edges), "edges")
    steps = []
    while not rest.isEmpty():
        turn = F.lit(len(steps))
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.select("a", F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("v")).alias("to"))
        least = ranked.groupBy("a").agg(F.min("to").alias("to"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("v"))
        hook = materialize(least.select(F.col("a").alias("node"), F.least("to", own)["v"].alias("up")), "hooks")
        steps.append(hook)
        x = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        y = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        drawn = rest.join(x, "a").join(y, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        # a node that was hooked onto and hooks on itself keeps its own edge
        chain = hook.filter(F.col("node") != F.col("up")).select(F.col("node").alias("a"), F.col("up").alias("b"))
        rest = materialize(_plain(drawn.union(chain.join(hook.select(F.col("up").alias("a")).distinct(), "a", "left_semi"))), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = steps[-1].withColumnRenamed("up", "root")
    for hook in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("up"), "root")
        out = hook.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return materialize(out, "components")


def _plain(edges: DataFrame) -> DataFrame:
    pair = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pair.distinct()
