"""Connected components of a graph given as edges, by repeated contraction.

Every node moves to the smallest id in its neighbourhood, edges are rewritten to where
their ends moved, and the rounds go on until no edge is left. Ids are hashed first, so
the smallest neighbour is a random one and a round leaves about half of the nodes, also
on a chain. Minima are combined before the shuffle; a hub with many edges is one side
of joins whose other side has one row per node, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node, root`` for each node of ``edges`` (two bigint columns); equal roots mean
    connected. ``root`` is a hash of a node. No edges give an empty table."""
    # xxhash64 of a bigint is one to one
    current = cut(
        edges.where(F.col(source) != F.col(target))
        .select(F.xxhash64(source).alias("u"), F.xxhash64(target).alias("v"))
        .distinct()
    )
    moves: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = cut(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("to")))
        moves.append(move)
        left = move.select("u", F.col("to").alias("a"))
        right = move.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = current.join(left, "u").join(right, "v").where("a <> b")
        current = cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not moves:
        return edges.select(F.col(source).alias("node"), F.xxhash64(source).alias("root")).limit(0)
    roots = moves[-1].withColumnRenamed("to", "root")
    for move in reversed(moves[:-1]):
        onward = roots.withColumnRenamed("u", "to")
        roots = move.join(onward, "to", "left").select("u", F.coalesce("root", "to").alias("root"))
    ends = edges.select(F.col(source).alias("node")).union(edges.select(F.col(target).alias("node"))).distinct()
    return ends.join(roots, F.xxhash64(ends["node"]) == roots["u"]).select("node", "root")
