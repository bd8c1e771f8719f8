"""Nearest-neighbour joins between objects and points.

Exact, without comparing all pairs, and without a table of the pairs that are looked at: objects and points are dealt to
tasks once, and the search runs within the tasks.

1. A tree of cuts (``cells.Forest``) follows the density of the objects; objects of about one size make a tree of their own, so
   a large object doesn't widen the cells of small ones. A thin sample shapes the cuts, one pass over all objects counts their leaves and
   finds the boxes around their objects and anchors. A metric is never less than the Chebyshev distance to an object's box, and
   never more than the Euclidean distance to its anchor, so the boxes bound the distances to a cell's objects.
2. A point goes to the tasks whose objects can be among its k nearest: most points to one, those near a border to some.
3. A task halves its objects down to few and goes down with blocks of points (``cells.LocalTree``). If the metric tells distances of
   pairs (``Metric.pairs``), only pairs that rounding leaves open leave the task, else those that the bounds leave open.
4. The distance orders by (distance rounded to 9 digits, object id).

Groups of objects that fit a task have no tree; many share a task.

A metric without such bounds, or in more than ``GRID_DIM`` dimensions, is searched by a pivot table if it
obeys the triangle inequality (see ``pivots``), else compared block by block (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from orbitree.functions.metrics import Metric
from orbitree.operators import cells
from orbitree.operators.blocks import knn_blocks
from orbitree.operators.pivots import knn_pivots
from orbitree.storage import materialize

#: Trees of more dimensions prune too little.
GRID_DIM = 3
#: Objects of a task; fewer if the bounds alone decide, since more pairs leave it then.
LOCAL_OBJECTS, BOUND_OBJECTS = 50_000, 20_000
#: Points of a task, for metrics with ``pairs`` and by bounds alone.
LOCAL_POINTS, BOUND_POINTS = 200_000, 20_000
#: Leaves of the cuts for the objects of one task, leaves in all, and sampled objects of a leaf.
_FINE, _LEAVES, _SAMPLED = 64, 1 << 16, 16


def _sized(rows: DataFrame, d: int) -> DataFrame:
    """Rows with ``power``, the width of their object as a power of 4."""
    wide = F.greatest(*(F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(d)), F.lit(0.0))
    return rows.withColumn("power", F.coalesce(F.when(wide > 0, F.floor(F.log2(F.when(wide > 0, wide)) / 2)), F.lit(-10_000)).cast("int"))


def _bounds(rows: DataFrame, metric: Metric) -> DataFrame:
    """Rows with the ends of their boxes lo0, hi0, ..., and anchors a0, ...; what has a null or NaN there can't be near."""
    o = metric.of()
    named = [v.cast("double").alias(n) for i, (lo, hi) in enumerate(metric.box(o)) for n, v in ((f"lo{i}", lo), (f"hi{i}", hi))]
    rows = rows.select("*", *named, *(v.cast("double").alias(f"a{i}") for i, v in enumerate(metric.anchor(o))))
    return rows.where(" and ".join(f"{n}{i} is not null and not isnan({n}{i})" for i in range(metric.dim) for n in ("lo", "hi", "a")))


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names]) if names else np.zeros((len(table), 0))


def _shapes(table: pa.Table) -> np.ndarray:
    """Arrays of numbers as rows of a matrix; shorter ones are filled up with NaN."""
    column = table.column("shape_").combine_chunks()
    size = column.value_lengths().to_numpy()
    out = np.full((len(column), int(size.max(initial=0))), np.nan)
    out[np.arange(out.shape[1])[None] < size[:, None]] = column.flatten().to_numpy()
    return out


def _unlike(table: pa.Table, columns: tuple[str, ...], k: int, last: bool) -> np.ndarray:
    """Of objects that are alike in all columns only the first k ids can be among the nearest; the others stay out."""
    try:
        rows = table.select(["object_id", *columns]).to_pandas().sort_values("object_id", ascending=not last)
        return np.sort(rows.index.to_numpy()[(rows.groupby(list(columns), dropna=False).cumcount() < k).to_numpy()])
    except TypeError:  # arrays don't group
        return np.arange(len(table))


def candidates(objects: DataFrame, points: DataFrame, metric: Metric, k: int, by: str | None = None, only: DataFrame | None = None, local: int | None = None, last: bool = False) -> DataFrame:
    """(point_id, [by], object_id, dist) of all pairs that can be among a point's k nearest.

    With ``by``, the nearest of each group of objects are meant; ``only`` (point_id, by) names the
    groups that a point asks for, otherwise all. Points with a null coordinate and objects with a
    null box are left out; a group of fewer than k objects is compared whole. With ``last``, of equal distances the larger ids come first."""
    d, axes, pairs = metric.dim, list(metric.axes), metric.pairs
    key = [by] if by else []
    most_points = LOCAL_POINTS if pairs else BOUND_POINTS
    rows = objects.select("object_id", *key, *metric.columns)
    spots = points.select("point_id", *axes).where(" and ".join(f"{c} is not null" for c in axes))
    sized = _sized(_bounds(rows, metric), d)
    counts = materialize(sized.groupBy(*key, "power").agg(F.count("*").alias("n")), "counts")
    if only is not None:
        asked = spots.join(only.select("point_id", *key).distinct(), "point_id")
    else:
        asked = spots.crossJoin(counts.select(*key).distinct()) if by else spots
    total = counts.agg(F.sum("n")).first()[0] or 0
    if local is None:
        local = min(LOCAL_OBJECTS if pairs else BOUND_OBJECTS, max(2000, ceil(total / 64)))
    sums = counts.groupBy(*key).agg(F.sum("n").alias("all_"))
    big = sums.where(F.col("all_") > local)
    trees = (counts.join(F.broadcast(big), key) if by else counts.crossJoin(F.broadcast(big))).select(*key, "power", "n").collect()  # sizes of groups that don't fit a task
    small_tasks = max(1, ceil(((sums.where(F.col("all_") <= local).agg(F.sum("all_")).first()[0]) or 0) / local))
    dealt, visits = rows.withColumn("task", F.lit(0).cast("long")), asked.withColumn("task", F.lit(0).cast("long")).withColumn("reach", F.lit(float("inf")))
    if by:
        hashed = F.pmod(F.xxhash64(*key), F.lit(small_tasks))
        dealt, visits = dealt.withColumn("task", hashed), visits.withColumn("task", hashed)
    tasks = small_tasks
    if trees:
        dealt, visits, more = _planted(sized, asked, metric, key, trees, k, local, small_tasks, dealt, visits)
        tasks += more
    visits = materialize(visits.select("point_id", *key, *axes, "reach", "task"), "visits")
    crowds = [(r.task, ceil(r.n / most_points)) for r in visits.groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > most_points).collect()]  # at most visits / most_points
    if crowds:
        parts = F.broadcast(rows.sparkSession.createDataFrame(crowds, "task long, parts_ int"))
        dealt = dealt.join(parts, "task", "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
        visits = visits.join(parts, "task", "left").withColumn("part_", F.pmod(F.xxhash64("point_id"), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    else:
        dealt, visits = dealt.withColumn("part_", F.lit(0)), visits.withColumn("part_", F.lit(0))
    spread = max(1, min(2000, tasks + sum(n for _, n in crowds)))
    meet = ["task", "part_"]
    dealt = _bounds(dealt.repartition(spread, *meet), metric)
    dealt = dealt.withColumn("shape_", F.transform(metric.shape(metric.of()), lambda v: v.cast("double"))) if pairs else dealt
    visits = visits.repartition(spread, *meet)
    lows, highs, anchors = ([f"{n}{i}" for i in range(d)] for n in ("lo", "hi", "a"))
    schema = StructType([StructField(f.name, f.dataType) for f in [*visits.select("point_id", *key, *axes).schema, *rows.select("object_id", *metric.columns).schema]])
    columns = metric.columns

    def search(o: pa.Table, p: pa.Table) -> pa.Table:
        groups = [(np.arange(len(o)), np.arange(len(p)))]
        if key:
            own, asking = ({name: at.values.to_numpy() for name, at in zip(t.column(0).to_pylist(), t.column(1).combine_chunks())} for t in (_grouped(o, key), _grouped(p, key)))
            groups = [(own[name], at) for name, at in asking.items() if name in own]
        lo, hi, anchor, q = _matrix(o, lows), _matrix(o, highs), _matrix(o, anchors), _matrix(p, axes)
        ids, reach, shape = o.column("object_id").to_numpy(), p.column("reach").to_numpy(), _shapes(o) if pairs else None
        found = []
        for at, asking in groups:
            if not len(at) or not len(asking):
                continue
            if pairs is None:
                at = at[_unlike(o.take(at), columns, k, last)]
            oi, pi = cells.contenders(lo[at], hi[at], anchor[at], ids[at], shape[at] if pairs else None, pairs, q[asking], reach[asking], k, last)
            found.append((at[oi], asking[pi]))
        oi, pi = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        left, right = p.select(["point_id", *key, *axes]).take(pa.array(pi)), o.select(["object_id", *columns]).take(pa.array(oi))
        return pa.table([*left.columns, *right.columns], names=[*left.column_names, *right.column_names])

    met = dealt.groupBy(*meet).cogroup(visits.groupBy(*meet)).applyInArrow(search, schema)
    return met.select("point_id", *key, "object_id", metric.distance(metric.of(), [F.col(c) for c in axes]).alias("dist"))


def _grouped(table: pa.Table, key: list[str]) -> pa.Table:
    """Each group's name and its rows."""
    names = table.select(key).append_column("at_", pa.array(np.arange(len(table))))
    return names.group_by(key).aggregate([("at_", "list")])


def _planted(sized: DataFrame, asked: DataFrame, metric: Metric, key: list[str], trees: list, k: int, local: int, base: int, dealt: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(objects, points, number of tasks) with the tasks of groups that need a tree; trees: (group, power, n), one row for each group and size."""
    spark, d, axes = sized.sparkSession, metric.dim, list(metric.axes)
    power = dict(zip(every := sorted({r.power for r in trees}), cells.classes(np.array(every) // 2).tolist()))
    names = {}
    size: dict[int, int] = {}
    for r in trees:
        tree = names.setdefault((*(r[n] for n in key), power[r.power]), len(names))
        size[tree] = size.get(tree, 0) + r.n
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*key, "power").schema)
    which = F.broadcast(spark.createDataFrame([(*(r[n] for n in key), r.power, names[(*(r[n] for n in key), power[r.power])]) for r in trees], f"{kind}, tree int"))
    middle = [((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).alias(f"m{i}") for i in range(d)]
    known = sized.join(which, [*key, "power"]).select(*sized.columns, "tree", *middle)
    fine = max(1, local // _FINE, ceil(sum(size.values()) / _LEAVES))
    leaves = [max(1, ceil(size[t] / fine)) for t in range(len(size))]
    thin = max(1, sum(size.values()) // (_SAMPLED * sum(leaves)))
    sample = known.where(F.pmod(F.xxhash64("object_id"), F.lit(thin)) == 0).select("tree", *(f"m{i}" for i in range(d))).toArrow()  # about _SAMPLED rows a leaf
    of, at = sample.column("tree").to_numpy(), _matrix(sample, [f"m{i}" for i in range(d)])
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(len(size) + 1))
    forest = cells.Forest([at[order[cut[t] : cut[t + 1]]] for t in range(len(size))], leaves)

    @F.pandas_udf("int")
    def leaf(tree: pd.Series, *centre: pd.Series) -> pd.Series:
        return pd.Series(forest.leaf(tree.to_numpy(), np.column_stack([c.to_numpy() for c in centre])))

    ends = [f(f"{n}{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    sides = [f(f"a{i}").alias(f"{n}{i}") for n, f in (("al", F.min), ("ah", F.max)) for i in range(d)]
    stats = known.withColumn("leaf", leaf("tree", *(f"m{i}" for i in range(d)))).groupBy("leaf").agg(F.count("*").alias("n"), *ends, *sides).toArrow()  # at most about _LEAVES rows
    boxes = np.array([_matrix(stats, [f"{n}{i}" for i in range(d)]) for n in ("lo", "hi", "al", "ah")])
    forest.bound(stats.column("leaf").to_numpy(), stats.column("n").to_numpy(), boxes, local, k)

    @F.pandas_udf("long")
    def task(tree: pd.Series, ids: pd.Series, *centre: pd.Series) -> pd.Series:
        out, have = np.full(len(tree), -1), tree.notna().to_numpy()
        out[have] = base + forest.deal(tree[have].to_numpy(int), np.column_stack([c.to_numpy() for c in centre])[have], ids[have].to_numpy())
        return pd.Series(out)

    placed = sized.join(which, [*key, "power"], "left").select(*sized.columns, "tree", *middle)
    own = task("tree", "object_id", *(f"m{i}" for i in range(d)))
    spare = dealt.drop("task").columns
    small = F.pmod(F.xxhash64(*key), F.lit(base)) if key else F.lit(0).cast("long")
    dealt = placed.select(*spare, own.alias("own_")).select(*spare, F.when(F.col("own_") >= 0, F.col("own_")).otherwise(small).alias("task"))

    groups: dict[tuple, list[int]] = {}
    for name, tree in names.items():
        groups.setdefault(name[:-1], []).append(tree)
    roots = list(groups.values())
    table = np.full((len(roots), max(map(len, roots))), -1)
    for i, r in enumerate(roots):
        table[i, : len(r)] = r
    if key:
        group = F.broadcast(spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*key).schema) + ", group_ int"))
        there, rest = asked.join(group, key), visits.join(group, key, "left_anti")
    else:
        there, rest = asked.withColumn("group_", F.lit(0)), None
    there = there.select("point_id", *key, *axes, "group_")
    kept = ["point_id", *key, *axes]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False) for a in axes])
            asks = table[batch.column("group_").to_numpy(zero_copy_only=False)]
            point, tasks, reach = forest.visit([asks[:, j] for j in range(asks.shape[1])], q)
            rows = batch.select(kept).take(pa.array(point))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(reach[point]), pa.array(base + tasks)], names=[*kept, "reach", "task"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in there.select(*kept).schema) + ", reach double, task long"
    found = there.mapInArrow(visit, schema)
    return dealt, found if rest is None else found.unionByName(rest.select(*kept, "reach", "task")), forest.tasks


def _bounded(metric: Metric) -> bool:
    return metric.box is not None and metric.anchor is not None and metric.dim <= GRID_DIM


def _unbounded(objects: DataFrame, points: DataFrame, metric: Metric, k: int, by: str | None = None, only: DataFrame | None = None, last: bool = False) -> DataFrame:
    """Pairs that hold the k nearest, without boxes: by pivots, or for groups and functions that
    are no metric by all blocks."""
    if metric.between is not None and metric.kernel is not None and by is None:
        return knn_pivots(objects, points, metric, k, last).drop("compared")
    return knn_blocks(objects, points, metric, k, by, only, last)


def nearest_neighbor(objects: DataFrame, points: DataFrame, metric: Metric, by: str | None = None, tie: str = "first", only: DataFrame | None = None, local: int | None = None) -> DataFrame:
    """(point_id, [by], object_id, dist) of the nearest object; ties by ``tie`` id."""
    key = ["point_id", *([by] if by else [])]
    sign = 1 if tie == "first" else -1
    pairs = candidates(objects, points, metric, 1, by, only, local, tie != "first") if _bounded(metric) else _unbounded(objects, points, metric, 1, by, only, tie != "first")
    near = pairs.groupBy(*key).agg(F.min(F.struct(F.round("dist", 9).alias("r"), (F.col("object_id") * sign).alias("o"), "dist")).alias("m"))
    return near.select(*key, (F.col("m.o") * sign).alias("object_id"), F.col("m.dist").alias("dist"))


def knn(objects: DataFrame, points: DataFrame, metric: Metric, k: int) -> DataFrame:
    """(point_id, rank, object_id, dist) of the k nearest objects of each point. The filter on the
    rank lets Spark keep k rows a point before the shuffle."""
    order = Window.partitionBy("point_id").orderBy(F.round("dist", 9), "object_id")
    pairs = candidates(objects, points, metric, k) if _bounded(metric) else _unbounded(objects, points, metric, k)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("point_id", F.col("rank").cast("long").alias("rank"), "object_id", "dist")


def nn_per_cluster(objects: DataFrame, points: DataFrame, metric: Metric, cluster: str = "label") -> DataFrame:
    """(point_id, cluster, object_id, dist): the nearest object of every cluster to each point."""
    return nearest_neighbor(objects, points, metric, by=cluster)


def distance_matrix(objects: DataFrame, centroids: list[list[float]], metric: Metric) -> DataFrame:
    """(object_id, c_idx, dist) to a short list of centroids (k points, k <= 10)."""
    o = metric.of()
    each: list[Column] = [F.struct(F.lit(i).cast("long").alias("c_idx"), metric.distance(o, [F.lit(float(v)) for v in c]).alias("dist")) for i, c in enumerate(centroids)]
    return objects.select("object_id", F.explode(F.array(*each)).alias("d")).select("object_id", "d.c_idx", "d.dist")
