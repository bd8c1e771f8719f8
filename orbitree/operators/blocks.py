"""Exact neighbours under a metric that gives no bounds: blocks of points against blocks of objects.

Without bounds every pair has to be compared. Points and objects are dealt to blocks by the hash of
their id; a task compares one block of points with one block of objects by the metric's kernel
and keeps the k nearest of each point, so memory is bounded by two blocks and only k rows a point
and block travel on. The points are a query set of a stated size.

Where points name the groups they ask for, only pairs within a group are compared: small groups share a task,
large ones are dealt to blocks of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitree.functions.metrics import Metric
from orbitree.storage import materialize

#: Rows of a block, about.
BLOCK = 2048


def _dealt(df: DataFrame, key: str, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Every row once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _within(things: DataFrame, asked: DataFrame, columns: tuple[str, ...], k: int, by: str, last: bool, block: int) -> tuple[DataFrame, DataFrame]:
    """Objects and asking points with ``task_``, ``o_`` and ``p_``, dealt so that a pair of one group meets once.

    Of objects of a group that are alike in all columns, the k that come first by id stay: no other can be
    among the nearest."""
    alike = Window.partitionBy(by, *columns).orderBy(F.desc("object_id") if last else F.asc("object_id"))
    things = things.join(asked.select(by).distinct(), by, "left_semi").withColumn("rank_", F.row_number().over(alike)).where(F.col("rank_") <= k).drop("rank_")
    things = materialize(things, "things")
    blocks = lambda df, name: df.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialize(blocks(things, "o_n").join(blocks(asked, "p_n"), by), "sizes")
    tasks = max(1, -(-max(things.count(), asked.count()) // block))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = df.join(sizes, by).withColumn("task_", F.pmod(F.xxhash64(by), F.lit(tasks)).cast("int")).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}n")).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1))).drop("o_n", "p_n")

    return dealt(things, "object_id", "o_", "p_"), dealt(asked, "point_id", "p_", "o_")


def knn_blocks(objects: DataFrame, points: DataFrame, metric: Metric, k: int, by: str | None = None, only: DataFrame | None = None, last: bool = False, block: int = BLOCK) -> DataFrame:
    """(point_id, [by], object_id, dist): of each block of objects the k nearest to each point, which
    hold the k nearest of all. Of equal distances (rounded to 9 digits) the smaller ids stay, or with
    ``last`` the larger ones. Points with a null coordinate are left out. With ``by``, k for each
    group; ``only`` (point_id, by) names the groups that a point asks for, and others aren't compared."""
    axes, key = list(metric.axes), [by] if by else []
    spots = points.select("point_id", *axes).where(" and ".join(f"{c} is not null" for c in axes))
    things = objects.select("object_id", *key, *metric.columns)
    if by and only is not None:
        asked = materialize(spots.join(only.select("point_id", by).distinct(), "point_id"), "asked")
        left, right = _within(things, asked, metric.columns, k, by, last, block)
        meet = ["task_", "o_", "p_"]
    else:
        n_p, n_o = (max(1, -(-df.count() // block)) for df in (spots, things))
        left, right = _dealt(things, "object_id", "o_", "p_", n_o, n_p), _dealt(spots, "point_id", "p_", "o_", n_p, n_o)
        meet = ["o_", "p_"]
    group_type = dict(objects.dtypes)[by] if by else None
    schema = "point_id long, " + (f"`{by}` {group_type}, " if by else "") + "object_id long, dist double"

    def compare(o: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(o) and len(p):
            coordinates, ids_of = np.array(p[axes[0]].tolist(), dtype=float) if axes == ["p"] else p[axes].to_numpy(dtype=float), p["point_id"].to_numpy()
            asking = p.groupby(by).indices if by in p else None
            for name, part in o.groupby(by, dropna=False) if by else [(None, o)]:
                at = np.arange(len(p)) if asking is None else asking.get(name, [])
                if not len(at):
                    continue
                part = part.sort_values("object_id", ascending=not last)
                dist = metric.matrix({c: part[c] for c in metric.columns}, coordinates[at])
                order = np.argsort(np.round(dist, 9), axis=0, kind="stable")[:k]
                ids = part["object_id"].to_numpy()
                out = pd.DataFrame({"point_id": np.tile(ids_of[at], len(order)), "object_id": ids[order].ravel(), "dist": np.take_along_axis(dist, order, 0).ravel()})
                if by:
                    out.insert(1, by, name)
                found.append(out)
        return pd.concat(found) if found else pd.DataFrame({"point_id": [], **({by: []} if by else {}), "object_id": [], "dist": []})

    found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(compare, schema)
    return found.where(F.col("dist").isNotNull() & ~F.isnan("dist"))
