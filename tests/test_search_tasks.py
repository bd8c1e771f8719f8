from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orbitree.functions.metrics import METRICS
from orbitree.operators import neighbors

RING = "object_id long, vertices array<struct<x: double, y: double>>"


def _brute(objects, points, metric, k, by=None):
    pairs = points.crossJoin(objects).withColumn("dist", metric.distance(metric.of(), [F.col(a) for a in metric.axes]))
    out = {}
    for r in pairs.select("point_id", F.lit(None).alias("g") if by is None else F.col(by).alias("g"), F.round("dist", 9).alias("d"), "object_id").collect():
        out.setdefault((r.point_id, r.g), []).append((r.d, r.object_id))
    return {i: [o for _, o in sorted(v)[:k]] for i, v in out.items()}


@pytest.mark.parametrize("k", [1, 3])
def test_overlapping_objects_leave_few_pairs_and_write_only_visits(spark, monkeypatch, k):
    written, write = [], neighbors.materialize

    def counted(df, tag):
        out = write(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(neighbors, "materialize", counted)
    draw, metric = random.Random(k), METRICS["squares"]
    objects = spark.createDataFrame([(i, draw.uniform(0, 20), draw.uniform(0, 20), float(1 + i % 4), draw.random()) for i in range(2000)], "object_id long, x0 double, y0 double, size double, theta double")
    points = spark.createDataFrame([(i, draw.uniform(-2, 22), draw.uniform(0, 20)) for i in range(150)], "point_id long, x double, y double")
    pairs = neighbors.candidates(objects, points, metric, k, local=300)
    got = {}
    for r in neighbors.knn(objects, points, metric, k).orderBy("rank").collect():
        got.setdefault((r.point_id, None), []).append(r.object_id)
    assert got == _brute(objects, points, metric, k)
    assert pairs.count() < 150 * k * 6 and sum(n for _, n in written) < 150 * 20


def test_groups_that_fill_tasks_and_groups_that_share_one(spark):
    draw, metric = random.Random(5), METRICS["polygons"]
    ring = lambda x, y, n: [{"x": x + draw.random(), "y": y + draw.random()} for _ in range(n)]
    objects = spark.createDataFrame([(i, ring(draw.uniform(0, 9), draw.uniform(0, 9), 3 + i % 5)) for i in range(300)], RING).withColumn("g", F.when(F.col("object_id") < 200, 0).otherwise(F.col("object_id") % 7).cast("long"))
    points = spark.createDataFrame([(i, draw.uniform(0, 10), draw.uniform(0, 10)) for i in range(40)], "point_id long, x double, y double")
    near = neighbors.nearest_neighbor(objects, points, metric, by="g", local=60)
    assert {(r.point_id, r.g): [r.object_id] for r in near.collect()} == _brute(objects, points, metric, 1, "g")
