"""Connected components by alternating stars over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from segspark.llm._hot import hot_from, hot_keys, join_unique
from segspark.llm._scratch import discard, materialize, tasks_for

#: Rounds after which something must be wrong; each shortens every path by about half.
ROUNDS = 60

def _shape(tree: DataFrame, tasks: int) -> Row:
    """``settled``: every component is one star, so no node has two parents and no parent has
    one; ``edges``; and the most ``parents`` and ``children`` that a node has."""
    ends = tree.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(tree.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).coalesce(tasks)
    loose = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0))
    return roles.agg((F.count_if(loose) == 0).alias("settled"), F.coalesce(F.sum("up"), F.lit(0)).alias("edges"), F.max("up").alias("parents"), F.max("down").alias("children")).first()


def connected_components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, component`` of every node that an edge (``a``, ``b``) touches, where
    ``component`` is the smallest node reachable.

    Nodes are of any orderable type.  Edges point from the larger node to the smaller one.
    Each round hands every node's larger neighbours to its smallest neighbour (large
    star), then its smaller ones (small star).  Minima are aggregated before the join,
    nodes with very many edges never gather in one task, and a round has as many tasks as
    its edges need.  Every round is written to
    the shared folder, so a lost executor costs no more than the round, and replaces the
    one before.  Loops and repeated edges are harmless; null ends are dropped.
    """
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    given = materialize(ends.distinct(), "edges")
    tasks = tasks_for(given.count())
    tree, written = given.filter("a <> b"), []
    for _ in range(rounds):
        shape = _shape(tree, tasks)
        if shape["settled"]:
            break
        tasks = tasks_for(shape["edges"])
        # A node that has no more edges than this is not hot, and large stars give none more parents.
        hot = lambda table, end, most: hot_keys(table, end, shape["edges"]).coalesce(tasks) if most > hot_from(shape["edges"]) else None  # noqa: B023, E731
        parents = tree.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).coalesce(tasks)
        large = join_unique(tree, "b", parents, "u", hot(tree, "b", shape["children"])).select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(large.coalesce(tasks).distinct().coalesce(tasks), "large-stars")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).coalesce(tasks)
        joined = join_unique(large, "a", least, "u", hot(large, "a", shape["parents"])).coalesce(tasks)
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        tree = materialize(small.distinct().coalesce(tasks), "edges")
        discard(*written, large)
        written = [tree]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = tree.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks)
    labels = tree.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    loops = given.filter("a = b").select(F.col("a").alias("node"))
    if loops.isEmpty():
        return labels
    return labels.unionByName(loops.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
