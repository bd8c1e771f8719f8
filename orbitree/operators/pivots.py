"""Exact neighbours under a metric without boxes, by the triangle inequality over a pivot table.

The metric says how far it can change between two points (``Metric.between``): |d(o, p) - d(o, v)| is
at most between(p, v). Some of the query points serve as pivots. Every object belongs to the pivot
that it is nearest to, its cell, and keeps that distance. A cell's least, k-th and largest distance
bound those to its objects from any point:

1. each point is compared within one cell, the one that promises the nearest k, which gives it a reach;
2. then with the other cells that the reach doesn't rule out, and in a cell only with objects whose pivot
   distance lies within the reach of the point's own.

Cells are dealt to tasks in blocks of objects and of points, so memory is bounded by two blocks. The
pivot table has at most ``MAX_PIVOTS`` rows and is the only thing shipped."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitree.functions.metrics import Metric
from orbitree.storage import materialize

MAX_PIVOTS = 512
#: Objects and points of a block, about.
BLOCK = 4096
_SLACK = 1e-9


def _coordinates(rows: pd.DataFrame, axes: list[str]) -> np.ndarray:
    return np.array(rows[axes[0]].tolist(), dtype=float) if axes == ["p"] else rows[axes].to_numpy(dtype=float)


def _celled(objects: DataFrame, metric: Metric, pivots: np.ndarray) -> DataFrame:
    """Objects with ``cell``, the nearest pivot, and ``own``, the distance to it; without a distance they go."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            dist = metric.matrix({c: rows[c] for c in metric.columns}, pivots)
            dist = np.where(np.isnan(dist), np.inf, dist)
            cell = dist.argmin(1)
            own = dist[np.arange(len(rows)), cell]
            yield rows.assign(cell=cell.astype(np.int32), own=own)[np.isfinite(own)]

    return objects.mapInPandas(run, f"{fields}, cell int, own double")


def _approached(points: DataFrame, metric: Metric, pivots: np.ndarray, cells: pd.DataFrame, home: bool) -> DataFrame:
    """(point_id, axes, reach, cell, blocks, at): the home cell of each point, or the other cells within its reach;
    at is the distance of the point to the cell's pivot."""
    axes = list(metric.axes)
    number, least, kth, most, blocks = (cells[n].to_numpy() for n in ("cell", "least", "kth", "most", "blocks"))
    types = ", ".join(f"{a} double" for a in axes) if axes != ["p"] else "p array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = metric.between(_coordinates(rows, axes), pivots[number])
            promise = at + kth
            own = promise.argmin(1)
            every = np.arange(len(rows))
            if home:
                i, j, reach = every, own, promise[every, own]
            else:
                reach = rows["reach"].to_numpy()
                near = np.maximum(at - most, least - at) <= reach[:, None] * (1 + _SLACK) + _SLACK
                near[every, own] = False
                i, j = np.nonzero(near)
                reach = reach[i]
            yield pd.DataFrame({"point_id": rows["point_id"].to_numpy()[i], **{a: rows[a].to_numpy()[i] for a in axes}, "reach": reach, "cell": number[j], "blocks": blocks[j], "at": at[i, j]})

    return points.mapInPandas(run, f"point_id long, {types}, reach double, cell int, blocks int, at double")


def _compared(held: DataFrame, asked: DataFrame, metric: Metric, k: int, last: bool) -> DataFrame:
    """(point_id, object_id, dist, compared): the k nearest of each block of a point's cells, and the distances
    computed for them (on one row of the block, 0 on the others)."""
    axes = list(metric.axes)
    asked = materialize(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "asked")
    crowd = materialize(asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices")), "crowd")
    asked = asked.join(F.broadcast(crowd), ["cell", "block"]).withColumn("slice", F.pmod(F.xxhash64("point_id"), F.col("slices")).cast("int"))
    dealt = crowd.select(F.col("cell").alias("cell_"), F.col("block").alias("block_"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))
    left = held.join(F.broadcast(dealt), (F.col("cell") == F.col("cell_")) & (F.col("block") == F.col("block_"))).drop("cell_", "block_")

    def compare(o: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"point_id": [], "object_id": [], "dist": [], "compared": []})]
        o = o.sort_values(["own", "object_id"])
        own, ids = o["own"].to_numpy(), o["object_id"].to_numpy()
        spots = _coordinates(p, axes) if len(p) else None
        for i, (point, reach, at) in enumerate(zip(p["point_id"], p["reach"], p["at"])):
            wide = reach * (1 + _SLACK) + _SLACK
            lo, hi = np.searchsorted(own, at - wide, "left"), np.searchsorted(own, at + wide, "right")
            if hi > lo:
                dist = metric.matrix({c: o[c].iloc[lo:hi] for c in metric.columns}, spots[i][None])[:, 0]
                best = np.lexsort((-ids[lo:hi] if last else ids[lo:hi], np.round(dist, 9)))[:k]
                found.append(pd.DataFrame({"point_id": point, "object_id": ids[lo:hi][best], "dist": dist[best], "compared": [int(hi - lo)] + [0] * (len(best) - 1)}))
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    return left.groupBy("cell", "block", "part").cogroup(asked.groupBy("cell", "block", "slice")).applyInPandas(compare, "point_id long, object_id long, dist double, compared long")


def knn_pivots(objects: DataFrame, points: DataFrame, metric: Metric, k: int, last: bool = False, n_pivots: int | None = None) -> DataFrame:
    """(point_id, object_id, dist, compared) that hold the k nearest objects of each point; the sum of
    ``compared`` is the number of distances computed beyond those to the pivots.

    Of equal distances (rounded to 9 digits) the smaller ids stay, or with ``last`` the larger ones. Points with a
    null coordinate are left out. The number of pivots is the root of the number of objects by default,
    from 1 to ``MAX_PIVOTS``: the points with the least hashes."""
    axes = list(metric.axes)
    spots = points.select("point_id", *axes).where(" and ".join(f"{c} is not null" for c in axes))
    things = objects.select("object_id", *metric.columns)
    n = things.count()
    wanted = min(MAX_PIVOTS, max(1, n_pivots or isqrt(n)))
    chosen = spots.select(*axes).distinct().orderBy(F.xxhash64(*axes), *axes).limit(wanted).toPandas()
    empty = points.sparkSession.createDataFrame([], "point_id long, object_id long, dist double, compared long")
    if not n or not len(chosen):
        return empty
    pivots = _coordinates(chosen, axes)
    held = materialize(_celled(things, metric, pivots), "celled")
    order = Window.partitionBy("cell").orderBy("own")
    kth = held.select("cell", "own").withColumn("k_", F.row_number().over(order)).where(F.col("k_") <= k).groupBy("cell").agg(F.max(F.when(F.col("k_") == k, F.col("own"))).alias("kth"))
    cells = held.groupBy("cell").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(kth, "cell").toPandas()  # a row a pivot
    if not len(cells):
        return empty
    whole = held.agg(F.count("*")).first()[0]
    cells["kth"] = cells["kth"].fillna(np.inf)
    if not np.isfinite(cells["kth"]).any() or whole < k:
        cells["kth"] = np.inf  # no cell holds k objects: all are compared
    blocks = dict(zip(cells["cell"], cells["blocks"]))
    number = F.create_map(*(F.lit(int(v)) for item in blocks.items() for v in item))
    dealt = materialize(held.withColumn("block", F.pmod(F.xxhash64("object_id"), number[F.col("cell")]).cast("int")), "dealt")
    at_home = materialize(_compared(dealt, _approached(spots, metric, pivots, cells, True), metric, k, last), "home")
    ranked = at_home.withColumn("k_", F.row_number().over(Window.partitionBy("point_id").orderBy("dist")))
    reach = ranked.where(F.col("k_") == k).select("point_id", F.col("dist").alias("reach"))
    reached = spots.join(reach, "point_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    return at_home.unionByName(_compared(dealt, _approached(reached, metric, pivots, cells, False), metric, k, last))
