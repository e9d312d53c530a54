"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.storage import stored


def connected_components(edges: DataFrame, name: str = "components", files: int | None = None) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; nodes of one component share a label.

    Each round joins every node to its smallest neighbour and keeps the edges between the
    joined nodes. Node ids are hashes, so no chain of increasing ids is long, and a round
    leaves at most a constant part of the nodes. All tables stay distributed; a node with very
    many edges is reduced to its smallest neighbour before the shuffle. Each table is written in at most ``files`` files.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), f"{name}-edges", files)
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        joined = joined.select("node", F.least("node", "near").alias("next"))
        joined = stored(joined, f"{name}-joined", files)
        if joined.isEmpty():
            return labels if labels is not None else joined.withColumnRenamed("next", "label")
        if labels is None:
            labels = joined.withColumnRenamed("next", "label")
        else:
            labels = labels.join(joined, labels["label"] == joined["node"], "left").select(
                labels["node"], F.coalesce("next", "label").alias("label")
            )
            labels = stored(labels, f"{name}-labels", files)
        left, right = joined.alias("l"), joined.alias("r")
        edges = (
            edges.join(left, F.col("a") == F.col("l.node"))
            .select(F.col("l.next").alias("a"), "b")
            .join(right, F.col("b") == F.col("r.node"))
            .select("a", F.col("r.next").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        edges = stored(edges, f"{name}-edges", files)
