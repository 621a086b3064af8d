"""Connected components by alternating large-star and small-star steps.

Each step is one grouping; edges move towards the smallest node until every node points
at its component's smallest. Rounds grow with the logarithm of the longest path, lineage
is cut by a table in the shared folder after each, and nothing but one count reaches
the driver. The smallest neighbour goes back to a node's edges by a join that spreads
the edges of hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import spread_join, stored

#: Rounds grow as the logarithm of the longest path, so only a fault can need so many.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link the neighbours of each node u to the least of them and u: the larger ones (large), or u and the smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = spread_join(both, least, ["u"], "n", total)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def component_of(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Self-loops and null ends are no edges; repeated edges count once.
    """
    at = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter(f"{src} <> {dst}").distinct()
    at = stored(at, "edges")
    seen, total = None, at.count()
    for _ in range(MAX_ROUNDS):
        # the first step makes at most two edges of one, on a side of the second
        at = stored(_star(_star(at, True, 2 * total), False, 2 * total), "edges")
        # edges settle when no round changes them: count and hash of the whole set
        mark = at.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen, total = mark, mark["n"]
    raise RuntimeError("components did not settle")
