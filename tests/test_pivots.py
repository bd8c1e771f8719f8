"""Search by pivots against blocks of all pairs, and metrics that users add through the tree."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitree.functions.metrics import METRICS, Metric, euclid_between, metric_of, vector_metric
from orbitree.operators import kmeans, neighbors, router, tree
from orbitree.operators.blocks import knn_blocks
from orbitree.operators.pivots import knn_pivots
from orbitree.plans.fixed_tree import DISCS

PLANE = Metric("plane", ("ax", "ay"), 2, kernel=lambda o, p: np.hypot(o["ax"][:, None] - p[None, :, 0], o["ay"][:, None] - p[None, :, 1]), between=euclid_between)


def _nearest(pairs, k):
    out = {}
    for r in pairs.select("point_id", F.round("dist", 9).alias("d"), "object_id").collect():
        out.setdefault(r.point_id, []).append((r.d, r.object_id))
    return {i: sorted(v)[:k] for i, v in out.items()}


@pytest.mark.parametrize("k", [1, 4])
def test_pivots_equal_blocks_and_compare_few(spark, k):
    draw = random.Random(k)
    objects = [(i, draw.random(), draw.random()) for i in range(2000)] + [(3000 + i, 0.5, 0.5) for i in range(40)] + [(5000, None, 0.1)]
    points = [(i, draw.random(), draw.random()) for i in range(300)] + [(900, None, 0.5), (901, 50.0, 50.0)]
    o, p = spark.createDataFrame(objects, "object_id long, ax double, ay double"), spark.createDataFrame(points, "point_id long, x double, y double")
    found = knn_pivots(o, p, PLANE, k)
    assert _nearest(found, k) == _nearest(knn_blocks(o, p, PLANE, k), k)
    assert found.agg(F.sum("compared")).first()[0] < len(objects) * len(points) / 10


def test_odd_tables(spark):
    o = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "object_id long, ax double, ay double")
    p = spark.createDataFrame([(1, 1.2, 0.0), (2, 9.0, 0.0)], "point_id long, x double, y double")
    assert _nearest(knn_pivots(o, p, PLANE, 9), 9) == _nearest(knn_blocks(o, p, PLANE, 9), 9)
    assert knn_pivots(o.limit(0), p, PLANE, 1).count() == 0 and knn_pivots(o, p.limit(0), PLANE, 1).count() == 0
    tied = spark.createDataFrame([(i, 1.0, 1.0) for i in range(6)], "object_id long, ax double, ay double")
    for tie, want in (("first", 0), ("last", 5)):
        assert {r.object_id for r in neighbors.nearest_neighbor(tied, p, PLANE, tie=tie).collect()} == {want}


def test_user_metric_through_the_tree(spark):
    draw = random.Random(3)
    discs = spark.createDataFrame([(i, draw.random(), draw.random(), draw.random() / 50) for i in range(240)], "object_id long, cx double, cy double, r double")
    points = spark.createDataFrame([(i, draw.random(), draw.random()) for i in range(40)], "point_id long, x double, y double")
    assign, nodes = tree.build_tree(discs, DISCS, 100, 3, 2)
    rows = {r.path: r for r in nodes.collect()}
    assert rows["0"].n == 240 and len(rows) > 3 and all(r.n <= 100 for r in rows.values() if r.is_leaf)
    assert rows["0"].bbox[0].lo <= 0.05 and rows["0"].bbox[0].hi >= 0.95
    table = router.inner_nodes(nodes, None)
    exact = {r.point_id: r.object_id for r in neighbors.nearest_neighbor(discs, points, DISCS).collect()}
    got = {r.point_id: r.object_id for r in router.query_tree(points, table, assign, DISCS).collect()}
    assert set(got) == set(exact) and sum(got[i] == exact[i] for i in exact) > 20
    plain = metric_of("plain", ("cx", "cy", "r"), 2, lambda o, p: max(float(np.hypot(*(o[:2] - p))) - o[2], 0.0))
    with pytest.raises(ValueError, match="no centre"):
        tree.build_tree(discs, plain, 100)


def test_vectors_through_the_tree(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.random(16) / 10 + i % 4).tolist()) for i in range(160)]
    objects, metric = spark.createDataFrame(rows, "object_id long, v array<double>"), vector_metric("v", 16)
    assign, nodes = tree.build_tree(objects, metric, 60, 4, 3)
    table = router.inner_nodes(nodes, None)
    points = spark.createDataFrame([(i, v) for i, v in rows[:30]], "point_id long, p array<double>")
    assert {r.point_id: r.object_id for r in router.query_tree(points, table, assign, metric).collect()} == {i: i for i in range(30)}
    seeds = kmeans.centroid_table(objects, {"0": [v for _, v in rows[:4]]})
    labelled, found, _ = kmeans.kmeans_fit(objects.withColumn("path", F.lit("0")), metric, seeds, 2, 4)
    assert {r.label for r in labelled.collect()} == {0, 1, 2, 3} and all(r.label == r.object_id % 4 for r in labelled.collect())
    for r in found.collect():
        assert r.c == pytest.approx(np.mean([v for i, v in rows if i % 4 == r.idx], axis=0))
    assert METRICS["squares"].at(F.col("p"))[1] is not None


def test_vector_tree_query(spark):
    from __spark_entry__ import queries

    sf_dir = "/root/testdata/sf0.001"
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = queries()["vector_tree"](spark, sf_dir).collect()
    assert sorted(r.point_id for r in rows) == sorted(vectors) and len({r.path for r in rows}) > 1
    for r in rows:
        same = min(i for i, v in vectors.items() if (v == vectors[r.point_id]).all())
        assert (r.object_id, r.dist) == (same, 0.0)


def test_ids_and_whole_numbers_stay_through_subtrees(spark):
    large = 2**60 + 1
    kernel = lambda o, p: np.hypot(o["ax"].astype(float)[:, None] % 1000 - p[None, :, 0], o["ay"][:, None] - p[None, :, 1])
    metric = Metric("whole", ("ax", "ay", "name"), 2, kernel=kernel, centre=lambda o: [(o["ax"] % 1000).cast("double"), o["ay"]])
    rows = [(large + 2 * i, 10**18 + i % 5 * 100 + 1, i / 7, None if i % 3 else str(i)) for i in range(60)]
    assign, nodes = tree.build_tree(spark.createDataFrame(rows, "object_id long, ax long, ay double, name string"), metric, 20, 3, 2)
    assert sorted(tuple(r) for r in assign.select("object_id", "ax", "ay", "name").collect()) == rows and nodes.count() > 3


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("k", [1, 3])
def test_only_asked_groups_are_compared(spark, k, last):
    """The kernel fails if a point meets an object of another group."""

    def kernel(o, p):
        gap = np.abs(o["ax"][:, None] - p[None, :, 0])
        if (gap > 50).any():
            raise ValueError("another group")
        return np.maximum(gap, np.abs(o["ay"][:, None] - p[None, :, 1]))

    metric, draw = Metric("apart", ("ax", "ay"), 2, kernel=kernel), random.Random(5)
    objects = [(i, f"g{i % 4}", i % 4 * 100 + draw.random(), draw.random()) for i in range(120)]
    objects += [(200 + i, "g1", 100.5, 0.5) for i in range(60)] + [(300, None, 0.0, 0.0), (301, "g9", 900.0, 0.0)]
    points = [(i, i % 4 * 100 + draw.random(), draw.random()) for i in range(90)] + [(500 + i, 100.5, 0.5) for i in range(30)] + [(600, None, 0.5)]
    asks = [(i, f"g{i % 4 if i < 500 else 1}") for i, *_ in points] * 2 + [(0, None), (0, "g7"), (700, "g1")]
    o, p = spark.createDataFrame(objects, "object_id long, g string, ax double, ay double"), spark.createDataFrame(points, "point_id long, x double, y double")
    found = knn_blocks(o, p, metric, k, "g", spark.createDataFrame(asks, "point_id long, g string"), last, block=16)
    got = {}
    for r in found.collect():
        got.setdefault((r.point_id, r.g), []).append((round(r.dist, 9), -r.object_id if last else r.object_id))
    want = {}
    for i, x, y in points:
        if x is not None:
            g = dict(asks[: len(points)])[i]
            want[i, g] = sorted((round(max(abs(ax - x), abs(ay - y)), 9), -j if last else j) for j, h, ax, ay in objects if h == g)[:k]
    assert {key: sorted(v)[:k] for key, v in got.items()} == want
