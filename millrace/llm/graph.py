"""Connected components over edges that stay on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node that an edge (a, b) names.

    In each round every node takes the least label among its own and its
    neighbours', then the label of its label; a long chain so halves about each
    round. Neither the edges of a node with very many neighbours nor the nodes
    of a large component meet in one task: labels are joined by ``join_by_key``,
    minima are combined before the shuffle. The loop ends when no label changes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    n_edges = both.count()
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"), F.count("*").alias("degree")).withColumnRenamed("a", "node"))
    n_nodes = labels.count()
    for _ in range(most_rounds):
        ends = labels.select(F.col("node").alias("b"), "component", "degree")
        near = join_by_key(both, ends, "b", "degree", n_edges).groupBy("a").agg(F.min("component").alias("near"))
        taken = cut(labels.join(near, labels["node"] == near["a"]).select("node", "degree", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        sizes = taken.groupBy("component").agg(F.count("*").alias("n"))
        further = cut(sizes.join(taken.select(F.col("node").alias("component"), F.col("component").alias("further")), "component"))  # every label is a node
        jumped = cut(join_by_key(taken, further, "component", "n", n_nodes).select("node", "degree", "was", F.least("component", "further").alias("component")))
        changed = jumped.filter("component <> was").limit(1).count()
        labels = jumped.drop("was")
        if not changed:
            return labels.drop("degree")
    raise RuntimeError("components didn't settle; raise most_rounds")
