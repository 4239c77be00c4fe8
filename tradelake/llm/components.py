"""Connected components by repeated contraction.

In each round every node takes, of itself and its neighbours, the one with the smallest hash for that round, and each edge
is moved to what its ends took; edges within one node go. With a fresh random order a round, nodes fall by a constant
factor, so rounds grow with the logarithm of a component's size. Edges, choices and labels stay distributed tables; only a
count of remaining edges reaches the driver. Choices are written before they are joined, which lets AQE split the edges of
a node with very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelake.llm.common import materialize, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), two long ids each -> (node, root), a row for each node with an edge to another node.

    Nodes have the same root if and only if they are connected; which of its nodes is the root is arbitrary. Repeated
    edges, edges in both directions and loops are allowed; nulls are not.
    """
    with scratch(edges.sparkSession):
        found = _contracted(edges)
        if found is not None:
            return materialize(found, keep=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def _contracted(edges: DataFrame) -> DataFrame | None:
    left = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")), F.struct(F.col("a").alias("node"), F.col("a").alias("other")), F.struct(F.col("b").alias("node"), F.col("b").alias("other")))).alias("e")).select("e.*")
        order = F.xxhash64("other", F.lit(turn))
        took = materialize(ends.groupBy("node").agg(F.min_by("other", order).alias("root")))
        if labels is None:
            labels = took
        else:
            labels = materialize(labels.join(took.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        of_a = took.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = took.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(of_a, "a").select("ra", "b").join(of_b, "b").where("ra != rb")
        left = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels
