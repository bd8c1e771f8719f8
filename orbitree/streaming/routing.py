"""Routing of a stream of points. Routes don't depend on other rows, so the batch function serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orbitree.operators.router import Tree, route_greedy


def route_stream(points: DataFrame, tree: Tree, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Route a streaming DataFrame of points and append the routes as Parquet, exactly once. The
    tree has to fit one table, for a stream can't be passed over several times."""
    if not isinstance(tree, dict):
        raise ValueError("the tree is larger than one table: raise max_bytes of inner_nodes")
    routes = route_greedy(points, tree, dim)
    return routes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
