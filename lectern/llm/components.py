"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours (summed on the map side, so that a node with very
    many links is one row for each task), then follows labels to their own labels, until nothing changes. Joins are
    of plain exchanges, which Spark splits where a node or component is very large.
    """
    both = stage_table(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    changed = True
    while changed:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b")
        least = stage_table(seen.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")), "near")
        moved = stage_table(
            labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "moved"
        )
        up = moved.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        labels = stage_table(
            moved.join(up, "component").select("node", "old", F.least("component", "higher").alias("component")), "labels"
        )
        changed = not labels.where("component <> old").isEmpty()
        labels = labels.select("node", "component")
    return labels
