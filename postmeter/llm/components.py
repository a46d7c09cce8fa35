"""Connected components of links, by hooking, jumping and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; the smallest node names it.

    In each round every node hooks onto its smallest neighbour if that is smaller,
    pointers are followed to their roots in tripling steps, and the links between
    roots go on.  Every step is a join or a pre-aggregated grouping on node pairs,
    and no neighbourhood is gathered.
    """
    edges = keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = keep(nodes.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = keep(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("parent")),
            "parents",
        )
        while True:
            above = parents.toDF("parent", "above")
            top = parents.toDF("above", "top")
            jumped = keep(
                parents.join(above, "parent").join(top, "above").select(
                    "node", F.col("top").alias("parent"), (F.col("top") != F.col("above")).alias("moved")
                ),
                "parents",
            )
            moved = not jumped.where("moved").isEmpty()
            drop_kept(parents)
            parents = jumped.select("node", "parent")
            if not moved:
                break
        root = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        relabelled = keep(
            labels.join(root, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            ),
            "labels",
        )
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        contracted = keep(
            edges.join(of_a, "a").join(of_b, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a <> b").distinct(),
            "links",
        )
        drop_kept(labels, edges)
        labels, edges = relabelled, contracted
    return labels
