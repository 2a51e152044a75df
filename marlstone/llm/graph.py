"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b), which has no nulls.

    Each round maps a node to the smallest among itself and its neighbours and contracts the edges by that map; only nodes without a smaller
    neighbour stay, so that the number of rounds is logarithmic. Maps and edges are tables in the shared folder; nothing comes to the
    driver but counts. Hot nodes are split by adaptive joins, as both sides of each join are tables.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            labels = written(labels.join(parent.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        up = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        edges = edges.join(up("a"), "a").join(up("b"), "b").filter("a_up <> b_up")
        edges = written(edges.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        if not edges.take(1):
            # A chain of maps may leave labels that are not yet roots only while edges remain.
            return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
