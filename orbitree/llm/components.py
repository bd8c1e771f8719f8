"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component) for every node of an edge; component is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then follows that
    label once more, so path lengths shrink geometrically. Labels are written to the shared
    folder after each round; only a count of changed rows reaches the driver. Null ends are
    ignored; repeated edges and loops change nothing; no edges give no rows."""
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        ahead = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = materialize(step.join(ahead, "component", "left").select("node", "old", F.least("component", "further").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("old != component").isEmpty():
            return labels
