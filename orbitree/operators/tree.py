"""Hierarchical clustering tree, built level by level.

Tables: ``assign`` (object_id, object columns, path), one row per object with its leaf, and
``nodes`` (path, parent, depth, n, bbox, centroids, is_leaf). A path is the string of child
numbers from the root "0", one digit to the base 36 for each level; an ancestor is a prefix."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitree.functions.metrics import Metric
from orbitree.operators.grids import bounding_boxes
from orbitree.operators.kmeans import assign_nearest_centroid, contribution, kmeans_fit, kmeanspp_seed, relabel_dense
from orbitree.storage import materialize


#: Digits of a path; their order is the order of strings.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def digit(label: Column) -> Column:
    return F.lower(F.conv(label.cast("string"), 10, 36))


def divide(labelled: DataFrame) -> DataFrame:
    """Children paths: the path with the label behind it."""
    return labelled.withColumn("path", F.concat("path", digit(F.col("label"))))


#: Objects of a node whose whole subtree one task builds: in many dimensions, and in up to three.
LOCAL_OBJECTS, PLANAR_OBJECTS = 50_000, 350_000


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """The numbers of ``hashed_uniform``."""
    mixed = np.fmod(np.fmod(ids, 1000003) * 48271 + (seed * 69621 + 12345), 2147483647) * 16807
    return (np.fmod(mixed, 2147483647) + 0.5) / 2147483647.0


def _split(ids: np.ndarray, dist, sums: np.ndarray, weight: np.ndarray, centre: np.ndarray, k: int, n_iter: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 0, centroids of the used labels) of one node, by the draws and rules of ``kmeans_fit``;
    dist gives the distances to points."""

    def nearest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = dist(points)
        label = np.round(every, 9).argmin(1)
        return label, every[np.arange(len(ids)), label]

    chosen: list[np.ndarray] = []
    for i in range(k):
        race = -np.log(_uniform(ids, seed * 31 + i))
        if chosen:
            far = nearest(np.array(chosen))[1]
            race = np.divide(race, far, out=np.full(len(ids), np.inf), where=far > 0)
        chosen.append(centre[np.lexsort((ids, race))[0]])
    points = np.array(chosen)
    for _ in range(n_iter):
        label = nearest(points)[0]
        total = np.zeros((len(points), points.shape[1]))
        np.add.at(total, label, sums)
        mass = np.bincount(label, weight, len(points))
        after = total[mass > 0] / mass[mass > 0][:, None]
        if after.shape == points.shape and (after == points).all():
            break
        points = after
    label = nearest(points)[0]
    used, dense = np.unique(label, return_inverse=True)
    return dense, points[used]


def _subtrees(rows: DataFrame, metric: Metric, threshold: int, k: int, n_iter: int, seed: int) -> DataFrame:
    """(object_id, object columns, path, centroids): the subtrees of nodes that fit a task, each in one group:
    a row for every object with its leaf, and one without an object for every node that was split."""
    cols = ["object_id", *metric.columns]
    sums, weight = contribution(metric)
    centre = metric.centre(metric.of())
    axes, apart = len(centre), len(centre) <= 3  # numbers in columns of their own take less memory than arrays
    named = [v.cast("double").alias(f"{n}{i}") for n, each in (("sums_", sums), ("centre_", centre)) for i, v in enumerate(each)] if apart else [F.array(*sums).alias("sums_"), F.array(*centre).alias("centre_")]
    ready = rows.select(*cols, "path", weight.alias("weight_"), *named)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*cols, "path").schema) + ", centroids array<array<double>>"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, weight_ = pdf["object_id"].to_numpy(np.int64), pdf["weight_"].to_numpy(float)
        sums_, centre_ = (pdf[[f"{c}{i}" for i in range(axes)]].to_numpy(dtype=float) if apart else np.array(pdf[c].tolist(), dtype=float) for c in ("sums_", "centre_"))
        columns = {c: pdf[c] for c in metric.columns}
        path = pdf["path"].to_numpy(object).copy()
        inner, waiting = [], [(path[0], np.arange(len(pdf)))]
        while waiting:
            name, at = waiting.pop()
            if len(at) <= threshold:
                continue
            part = {c: v.iloc[at] for c, v in columns.items()}
            label, points = _split(ids[at], lambda p, part=part: metric.matrix(part, p), sums_[at], weight_[at], centre_[at], k, n_iter, seed + len(name) - 1)
            if len(points) < 2:
                continue
            inner.append((name, points.tolist()))
            for z in range(len(points)):
                path[at[label == z]] = name + DIGITS[z]
                waiting.append((name + DIGITS[z], at[label == z]))
        # as objects, what is missing stays None beside ids and arrays; else ids become floats and arrays NaN
        out = pdf[cols].assign(path=path, centroids=None).astype(object)
        nodes = pd.DataFrame([dict.fromkeys(cols) | {"path": n, "centroids": c} for n, c in inner], columns=out.columns, dtype=object)
        return pd.concat([out, nodes], ignore_index=True)

    return ready.groupBy("path").applyInPandas(build, schema)


def build_tree(objects: DataFrame, metric: Metric, threshold: int, k: int = 3, n_iter: int = 10, seed: int = 0, local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(assign, nodes). All nodes of a level with more than ``threshold`` objects are split in the
    same jobs, level by level until none is left; a node whose clusters collapse into one stays a
    leaf. Children are smaller than their parent, so the levels end. k = 0 means 2**dim. Nodes of at most
    ``local`` objects (by default ``PLANAR_OBJECTS`` in up to three dimensions, else ``LOCAL_OBJECTS``) are finished with their whole
    subtree in one task each, if the metric has a kernel."""
    if local is None:
        local = PLANAR_OBJECTS if metric.dim <= 3 else LOCAL_OBJECTS
    if metric.centre is None:
        raise ValueError(f"the metric {metric.name} has no centre, so its objects have no means")
    k = k or 2**metric.dim
    if k > len(DIGITS):
        raise ValueError(f"a path has one digit per level: at most {len(DIGITS)} children")
    cols = ["object_id", *metric.columns]
    active = materialize(objects.select(*cols, F.lit("0").alias("path")), "level")
    done, nodes = None, None
    for depth in count():
        boxes = bounding_boxes(active, metric)
        small = (F.col("n") > threshold) & (F.col("n") <= local) if metric.kernel is not None else F.lit(False)
        sized = materialize(boxes.withColumn("split", F.col("n") > threshold).withColumn("small", small), "boxes")
        finished = sized.where("small").select("path")
        if not finished.isEmpty():
            apart = active.join(F.broadcast(finished) if _few(finished) else finished, "path").select(*cols, "path")
            built = materialize(_subtrees(apart, metric, threshold, k, n_iter, seed), "subtrees")
            placed = built.where("object_id is not null").select(*cols, "path")
            below = placed.withColumn("path", F.explode(F.transform(F.sequence(F.lit(depth + 1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))))
            found = built.where("object_id is null").select("path", "centroids")
            deep = _node_rows(bounding_boxes(below, metric).join(found, "path", "left"))
            done, nodes = (new if old is None else old.union(new) for old, new in ((done, placed), (nodes, materialize(deep, "nodes"))))
        split = sized.where("!small").drop("small")
        active = active.join(finished, "path", "left_anti").select(*cols, "path") if metric.kernel is not None else active
        go = split.where("split").select("path")
        few = _few(go)
        rows = active.join(F.broadcast(go) if few else go, "path")
        rows = materialize(rows.select(*cols, "path"), "split")
        centroids = None
        if not rows.isEmpty():
            labelled, found, _ = kmeans_fit(rows, metric, kmeanspp_seed(rows, metric, k, seed + depth, few), n_iter, k, until_stable=True, few=few)
            labelled = materialize(labelled, "labelled")
            dense = relabel_dense(labelled)
            parts = dense.groupBy("path").agg(F.count("*").alias("parts"))
            good = materialize(dense.join(parts.where("parts > 1"), "path").select("path", "label", "dense"), "dense")
            centroids = found.join(good, (found.path == good.path) & (found.idx == good.label)).groupBy(found.path).agg(F.transform(F.sort_array(F.collect_list(F.struct("dense", "c"))), lambda s: s["c"]).alias("centroids"))
            children = labelled.join(good, ["path", "label"]).drop("label", "dist").withColumnRenamed("dense", "label")
        level = split.drop("split")
        level = level.join(centroids, "path", "left") if centroids is not None else level.withColumn("centroids", F.lit(None).cast("array<array<double>>"))
        level = materialize(_node_rows(level), "nodes")
        nodes = level if nodes is None else nodes.union(level)
        leaves = active.join(level.where("is_leaf").select("path"), "path", "left_semi").select(*cols, "path")
        done = leaves if done is None else done.union(leaves)
        if centroids is None or level.where("!is_leaf").isEmpty():
            break
        active = materialize(divide(children).select(*cols, "path"), "level")
    return materialize(done, "assign"), materialize(nodes, "tree")


def _node_rows(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.expr("substring(path, 1, length(path) - 1)").alias("parent"), (F.length("path") - 1).cast("int").alias("depth"), "n", "bbox", "centroids", F.col("centroids").isNull().alias("is_leaf"))


def _few(paths: DataFrame, bound: int = 100_000) -> bool:
    return paths.count() <= bound


def tree_leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf").select("path", "n").orderBy("path")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, leaves, height (longest path), objects, smallest and largest leaf."""
    size = F.when(F.col("is_leaf"), F.col("n"))
    return nodes.agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.max(F.length("path")).cast("long").alias("height"), F.sum(size).alias("n_objects"), F.min(size).alias("smallest_leaf"), F.max(size).alias("largest_leaf"))


@dataclass
class Snapshot:
    """A saved tree; ``routers`` are those of its inner nodes with their training history, if any were saved."""

    version: str
    assign: DataFrame
    nodes: DataFrame
    routers: DataFrame | None


def save_tree(assign: DataFrame, nodes: DataFrame, path: str, routers: DataFrame | None = None) -> str:
    """Save a tree, with its routers and what was recorded in training, as a new version; its name is returned.

    The parts go to a folder of their own; one row in the manifest, written last, makes them a version. So
    a save that was cut short is never loaded, and readers of older versions aren't disturbed."""
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    home = f"{path}/versions/{version}"
    nodes.write.parquet(f"{home}/nodes")
    assign.withColumn("depth1", F.substring("path", 1, 2)).write.partitionBy("depth1").parquet(f"{home}/assign")
    if routers is not None:
        routers.write.parquet(f"{home}/routers")
    spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.lit(time.time_ns()).alias("saved_at"), F.lit(routers is not None).alias("routers")).write.mode("append").parquet(f"{path}/manifest")
    return version


def load_snapshot(spark: SparkSession, path: str, version: str | None = None) -> Snapshot:
    """The named version of a saved tree, or the newest. Unknown versions are an error."""
    found = spark.read.parquet(f"{path}/manifest")
    found = found if version is None else found.where(F.col("version") == version)
    row = found.orderBy(F.desc("saved_at"), "version").first()
    if row is None:
        raise ValueError(f"no version {version} of a tree in {path}")
    home = f"{path}/versions/{row.version}"
    routers = spark.read.parquet(f"{home}/routers") if row.routers else None
    return Snapshot(row.version, spark.read.parquet(f"{home}/assign").drop("depth1"), spark.read.parquet(f"{home}/nodes"), routers)


def load_tree(spark: SparkSession, path: str, objects: DataFrame, metric: Metric, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The saved nodes, and objects routed from the root by nearest centroid."""
    nodes = load_snapshot(spark, path, version).nodes
    return assign_by_centroids(objects, nodes, metric), nodes


def assign_by_centroids(objects: DataFrame, nodes: DataFrame, metric: Metric) -> DataFrame:
    """(object_id, object columns, path): every object walks to its leaf by nearest centroid."""
    cols = ["object_id", *metric.columns]
    inner = nodes.where("!is_leaf").select("path", F.posexplode("centroids").alias("idx", "c"))
    rows = objects.select(*cols, F.lit("0").alias("path"))
    height, k = (v or 1 for v in nodes.agg(F.max("depth"), F.max(F.size("centroids"))).first())
    done = None
    for _ in range(height):
        stop = rows.join(inner.select("path").distinct(), "path", "left_anti").select(*cols, "path")
        done = stop if done is None else done.union(stop)
        rows = materialize(divide(assign_nearest_centroid(rows, inner, metric, k)).select(*cols, "path"), "walk")
    return rows.select(*cols, "path") if done is None else done.union(rows.select(*cols, "path"))
