from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitree.functions.metrics import METRICS, Metric, linf_kernel, metric_of
from orbitree.operators import accuracy, grids, kmeans, neighbors, overlap, router, tree
from orbitree.operators.overlap import square_boxes

SEGMENT = "object_id long, x0 double, y0 double, length double, theta double"


def _segments(spark, n=300, seed=1):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, draw.random(), draw.random() ** 3, draw.uniform(1e-5, 0.02), draw.uniform(0, 3.1)) for i in range(n)], SEGMENT)


def _points(spark, n=60, seed=2, wide=1.0):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, draw.uniform(-wide, 1 + wide) if i % 5 == 0 else draw.random(), draw.random()) for i in range(n)], "point_id long, x double, y double")


def _brute(objects, points, metric, k):
    pairs = points.crossJoin(objects).withColumn("dist", metric.distance(metric.of(), [F.col("x"), F.col("y")]))
    out = {}
    for r in pairs.select("point_id", F.round("dist", 9).alias("d"), "object_id").collect():
        out.setdefault(r.point_id, []).append((r.d, r.object_id))
    return {i: [o for _, o in sorted(v)[:k]] for i, v in out.items()}


@pytest.mark.parametrize("k", [1, 3, 400])
def test_knn_equals_cross_join(spark, k):
    objects, points, metric = _segments(spark), _points(spark), METRICS["segments2d"]
    got = {}
    for r in neighbors.knn(objects.repartition(3), points, metric, k).orderBy("rank").collect():
        got.setdefault(r.point_id, []).append(r.object_id)
    assert got == _brute(objects, points, metric, k)


def test_ties_groups_and_empty_tables(spark):
    metric = METRICS["segments2d"]
    twins = spark.createDataFrame([(5, 0.2, 0.2, 0.0, 0.0), (3, 0.2, 0.2, 0.0, 0.0), (9, 0.8, 0.8, 0.0, 0.0)], SEGMENT)
    spot = spark.createDataFrame([(1, 0.2, 0.3), (2, None, 0.1)], "point_id long, x double, y double")
    assert [r.object_id for r in neighbors.nearest_neighbor(twins, spot, metric).collect()] == [3]
    assert [r.object_id for r in neighbors.nearest_neighbor(twins, spot, metric, tie="last").collect()] == [5]
    grouped = twins.withColumn("g", F.col("object_id") > 5)
    assert {(r.g, r.object_id) for r in neighbors.nearest_neighbor(grouped, spot, metric, by="g").collect()} == {(False, 3), (True, 9)}
    assert neighbors.nearest_neighbor(twins.limit(0), spot, metric).count() == 0
    assert neighbors.nearest_neighbor(twins, spot.limit(0), metric).count() == 0


def test_overlap_and_thinning(spark):
    draw = random.Random(4)
    rows = [(i, draw.uniform(0, 30), draw.uniform(0, 30), float(1 + i % 4), 0.0) for i in range(250)] + [(900, 100.0, 100.0, 2.0, 0.0), (901, 102.0, 100.0, 2.0, 0.0)]
    squares = spark.createDataFrame(rows, "object_id long, x0 double, y0 double, size double, theta double")
    hit = lambda a, b: abs(a[1] - b[1]) <= (a[3] + b[3]) / 2 and abs(a[2] - b[2]) <= (a[3] + b[3]) / 2
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and hit(a, b)}
    assert {(r.a, r.b) for r in overlap.overlap_join(squares, square_boxes).collect()} == pairs and (900, 901) in pairs
    kept = []
    for row in rows:
        if not any(hit(row, k) for k in kept):
            kept.append(row)
    thin = overlap.thin_non_overlapping(squares, square_boxes)
    assert {r.object_id for r in thin.collect()} == {k[0] for k in kept}
    ranks = {r.object_id: r.rank for r in overlap.ranked(thin, slices=7).collect()}
    assert ranks == {k[0]: i + 1 for i, k in enumerate(kept)}
    stopped, run, accepted = [], 0, {k[0] for k in kept}
    for row in rows:
        if row[0] in accepted:
            stopped.append(row[0])
            run = 0
        else:
            run += 1
            if run >= max(1, int(0.05 * len(rows))):
                break
    assert sorted(r.object_id for r in overlap.stop_after_rejects(squares, thin).collect()) == stopped
    assert overlap.thin_non_overlapping(squares.limit(0), square_boxes).count() == 0


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_thinning_in_blocks_of_any_size(spark, block):
    draw = random.Random(block)
    rows = [(i, draw.gauss(0, 5), draw.gauss(0, 5), draw.choice([0.5, 1.0, 3.0])) for i in range(300)] + [(1000, 0.0, 0.0, 40.0), (1001, 0.0, 60.0, 1.0), (1002, None, 0.0, 1.0)]
    squares = spark.createDataFrame(rows, "object_id long, x0 double, y0 double, size double")
    kept = []
    for row in rows:
        if row[1] is None or not any(k[1] is not None and abs(row[1] - k[1]) <= (row[3] + k[3]) / 2 and abs(row[2] - k[2]) <= (row[3] + k[3]) / 2 for k in kept):
            kept.append(row)
    assert sorted(r.object_id for r in overlap.thin_non_overlapping(squares.repartition(3), square_boxes, block).collect()) == [k[0] for k in kept]


def test_thinning_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tags, write = [], overlap.materialize
    monkeypatch.setattr(overlap, "materialize", lambda df, tag: (tags.append(tag), write(df, tag))[1])
    chain = spark.range(100_000).select(F.col("id").alias("object_id"), (F.col("id") * 0.9).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("size"))
    kept = overlap.thin_non_overlapping(chain, square_boxes, 10_000)
    assert kept.agg(F.count("*"), F.max("object_id"), F.sum(F.col("object_id") % 2)).first() == (50_000, 99_998, 0)
    assert tags.count("decided") < 20


@pytest.mark.parametrize("dim, per_axis", [(2, 1), (2, 2), (2, 41), (3, 20)])
def test_border_by_refinement_equals_the_whole_lattice(spark, dim, per_axis):
    draw = random.Random(dim)
    boxes = [(path, [(draw.uniform(-3, 0), draw.uniform(1, 4)) for _ in range(dim)]) for path in ("0", "01", "02")] + [("03", [(1.0, 1.0)] * dim)]
    nodes = spark.createDataFrame(boxes, "path string, bbox array<struct<lo: double, hi: double>>")
    cents = spark.createDataFrame([(path, i, [draw.uniform(lo, hi) for lo, hi in box]) for path, box in boxes for i in range(1 if path == "02" else 4)], "path string, idx int, c array<double>")
    for epsilon in (0.001, 0.15):
        whole, fine = (sorted((r.path, r.grid_id, tuple(r.p)) for r in grids.uncertainty_points(points, cents, nodes, epsilon, dim, 10**6).collect()) for points in (grids.lattice(nodes, per_axis, dim), grids.border_lattice(nodes, cents, per_axis, dim, epsilon)))
        assert fine == whole and (per_axis < 3 or whole)
    assert per_axis < 20 or grids.border_lattice(nodes, cents, per_axis, dim, 0.001).count() < 0.75 * grids.lattice(nodes, per_axis, dim).count()


def test_kmeans_against_numpy(spark):
    metric, seeds = METRICS["segments2d"], [[0.2, 0.2], [0.8, 0.2], [0.5, 0.9]]
    objects = _segments(spark, 200).withColumn("path", F.lit("0"))
    labelled, _, history = kmeans.kmeans_fit(objects, metric, kmeans.centroid_table(objects, {"0": seeds}), 3, 3)
    rows = objects.orderBy("object_id").collect()
    a = np.array([[r.x0, r.y0] for r in rows])
    d = np.array([[r.length * np.cos(r.theta), r.length * np.sin(r.theta)] for r in rows])

    def dist(c):
        t = np.clip(((c - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        return np.hypot(*(a + t[:, None] * d - c).T)

    cents = [np.array(s) for s in seeds]
    for _ in range(3):
        lab = np.argmin([dist(c) for c in cents], axis=0)
        cents = [(a + d / 2)[lab == j].mean(0) for j in range(len(cents)) if (lab == j).any()]
    lab = np.argmin([dist(c) for c in cents], axis=0)
    assert [r.label for r in labelled.orderBy("object_id").collect()] == lab.tolist()
    assert history.count() == 3


def test_seeding_ignores_partitioning(spark):
    objects = _segments(spark).withColumn("path", F.when(F.col("object_id") % 2 == 0, "00").otherwise("01"))
    one, many = ({(r.path, r.idx): r.c for r in kmeans.kmeanspp_seed(objects.repartition(n), METRICS["segments2d"], 3).collect()} for n in (1, 11))
    assert one == many and len(one) == 6


def test_tree_and_routing(spark, tmp_path):
    metric, objects = METRICS["segments2d"], _segments(spark, 400)
    assign, nodes = tree.build_tree(objects, metric, 100, 3, 3)
    rows = {r.path: r for r in nodes.collect()}
    assert rows["0"].n == 400 and assign.count() == 400
    for path, r in rows.items():
        children = [c for c in rows.values() if c.parent == path and len(path) > 0]
        assert r.is_leaf or sum(c.n for c in children) == r.n
        assert not r.is_leaf or r.n <= 100
    leaves = {r.path: r.n for r in tree.tree_leaves(nodes).collect()}
    assert leaves == {r.path: r["count"] for r in assign.groupBy("path").count().collect()}
    tree.save_tree(assign, nodes, str(tmp_path / "t"))
    again, _ = tree.load_tree(spark, str(tmp_path / "t"), objects, metric)
    assert {(r.object_id, r.path) for r in again.collect()} == {(r.object_id, r.path) for r in assign.collect()}

    inner = nodes.where("!is_leaf")
    cents = inner.select("path", F.posexplode("centroids").alias("idx", "c"))
    border = grids.uncertainty_points(grids.lattice(inner, 12, 2), cents, inner, 0.15, 2, 80)
    held = router.prefixes(assign, metric).where(F.length("node") > 1)
    children = held.select("object_id", *metric.columns, F.expr("substring(node, 1, length(node) - 1)").alias("path"), F.expr("substring(node, length(node), 1)").alias("label"))
    labelled = router.label_uncertainty(border, children, metric).join(inner.select("path", F.size("centroids").alias("children")), "path")
    routers = router.fit_router(labelled, 24, 2, 60, 0.02)
    assert all(r.accuracy > 0.5 for r in routers.collect())
    table, points = router.inner_nodes(nodes, routers), _points(spark, 40, wide=0.0)
    exact = {r.point_id: r.object_id for r in neighbors.nearest_neighbor(objects, points, metric).collect()}
    got = {r.point_id: r.object_id for r in router.query_tree(points, table, assign, metric).collect()}
    assert set(got) == set(exact) and sum(got[i] == exact[i] for i in exact) > len(exact) / len(leaves)
    routes = {r.point_id: r.visited for r in router.route_greedy(points, table, 2).collect()}
    first = tree.save_tree(assign, nodes, str(tmp_path / "u"), routers)
    saved = tree.load_snapshot(spark, str(tmp_path / "u"))
    assert saved.version == first and {(r.object_id, r.path) for r in saved.assign.collect()} == {(r.object_id, r.path) for r in assign.collect()}
    assert {r.point_id: r.visited for r in router.route_greedy(points, router.inner_nodes(saved.nodes, saved.routers), 2).collect()} == routes
    assert {(r.path, r.step, r.accuracy) for r in accuracy.router_training_accuracy(saved.routers).collect()} == {(r.path, r.step, r.accuracy) for r in accuracy.router_training_accuracy(routers).collect()}
    tree.save_tree(assign, nodes.where("path = '0'"), str(tmp_path / "u"))
    newest = tree.load_snapshot(spark, str(tmp_path / "u"))
    assert newest.routers is None and newest.nodes.count() == 1 and tree.load_snapshot(spark, str(tmp_path / "u"), first).nodes.count() == len(rows)
    nodes.write.parquet(str(tmp_path / "u" / "versions" / "cut_short" / "nodes"))
    assert tree.load_snapshot(spark, str(tmp_path / "u")).version == newest.version
    with pytest.raises(ValueError):
        tree.load_snapshot(spark, str(tmp_path / "u"), "cut_short")
    parts = router.inner_nodes(nodes, routers, 9000)
    assert isinstance(parts, router.Parts) and sum(map(len, parts.levels)) > 2
    assert {r.point_id: r.visited for r in router.route_greedy(points, parts, 2).collect()} == routes
    alike = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows.collect())
    for call in (lambda t: router.score_router(points, t, 2), lambda t: router.route_beam(points, t, 2, 2, 5.0), lambda t: router.leaf_sums(points, t, 2, True), lambda t: router.route_by_sums(points, t, 2).select("point_id", "path", "score")):
        assert alike(call(parts)) == alike(call(table))
    everything = router.route_beam(points, table, 2, 100, 1e9)
    near = router.query_leaf(everything.join(points, "point_id"), assign, metric).groupBy("point_id").agg(F.min(F.struct(F.round("dist", 9), "object_id")).alias("m"))
    assert {r.point_id: r.m.object_id for r in near.collect()} == exact
    verbose = router.query_tree_verbose(points, table, assign, metric)
    last = {r.point_id: r.object_id for r in verbose.groupBy("point_id").agg(F.max_by("object_id", "layer").alias("object_id")).collect()}
    assert last == got
    layers = accuracy.layer_accuracy(verbose, neighbors.knn(objects, points, metric, 1), max(len(p) for p in rows) - 1, 40)
    values = [r.accuracy for r in layers.orderBy("layer").collect()]
    assert values == sorted(values, reverse=True) and values[-1] == pytest.approx(100 * sum(got[i] == exact[i] for i in exact) / 40)
    for running in (False, True):
        every = router.leaf_sums(points, table, 2, running).groupBy("point_id").agg(F.count("*").alias("n"), F.max(F.struct("score", "path")).alias("m"))
        best = {r.point_id: (r.path, r.score) for r in router.route_by_sums(points, table, 2, running).collect()}
        for r in every.collect():
            assert r.n == len(leaves) and best[r.point_id] == (r.m.path, pytest.approx(r.m.score))


def test_collapsed_node_stays_a_leaf(spark):
    same = spark.createDataFrame([(i, 0.5, 0.5, 0.0, 0.0) for i in range(30)], SEGMENT)
    assign, nodes = tree.build_tree(same, METRICS["segments2d"], 10, 3, 2)
    assert [(r.path, r.is_leaf, r.n) for r in nodes.collect()] == [("0", True, 30)] and assign.count() == 30


SQUARE = "object_id long, x0 double, y0 double, size double, theta double"


def test_one_large_object_adds_a_pair_a_point(spark):
    draw, metric = random.Random(6), METRICS["squares"]
    rows = [(i, draw.uniform(0, 100), draw.uniform(0, 100), 1.0, 0.3) for i in range(2000)]
    points = spark.createDataFrame([(i, draw.uniform(-50, 150), draw.uniform(0, 100)) for i in range(300)], "point_id long, x double, y double")
    counts = []
    for more in ([], [(9000, 50.0, 50.0, 100.0, 0.0)]):
        objects = spark.createDataFrame(rows + more, SQUARE)
        counts.append(neighbors.candidates(objects, points, metric, 1).count())
        got = {r.point_id: [r.object_id] for r in neighbors.nearest_neighbor(objects, points, metric).collect()}
        assert got == _brute(objects, points, metric, 1)
    assert counts[0] < 300 * 60 and counts[1] <= counts[0] + 600


def test_overlaps_of_very_different_sizes(spark):
    draw = random.Random(7)
    rows = [(i, draw.uniform(0, 60), draw.uniform(0, 60), draw.choice([0.0, 0.01, 0.3, 1.0, 2.0, 5.0]), 0.0) for i in range(300)] + [(900, 30.0, 30.0, 64.0, 0.0), (901, 10.0, 10.0, None, 0.0)]
    hit = lambda a, b: abs(a[1] - b[1]) <= (a[3] + b[3]) / 2 and abs(a[2] - b[2]) <= (a[3] + b[3]) / 2
    pairs = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and hit(a, b)}
    found = [(r.a, r.b) for r in overlap.overlap_join(spark.createDataFrame(rows, SQUARE), square_boxes).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_a_plain_function_and_many_dimensions(spark):
    objects, points, metric = _segments(spark, 90), _points(spark, 25), METRICS["segments2d"]

    def distance(o, p):
        a, d = o[:2], o[2] * np.array([np.cos(o[3]), np.sin(o[3])])
        t = np.clip((p - a) @ d / (d @ d), 0, 1)
        return float(np.hypot(*(p - a - t * d)))

    mine = metric_of("mine", metric.columns, 2, distance, centre=metric.centre)
    nearest = lambda m: {(r.point_id, r.rank): r.object_id for r in neighbors.knn(objects, points, m, 3).collect()}
    assert nearest(mine) == nearest(metric)
    labels = lambda m: {r.object_id: r.label for r in kmeans.assign_nearest_centroid(objects.withColumn("path", F.lit("0")), kmeans.centroid_table(objects, {"0": [[0.2, 0.2], [0.8, 0.1]]}), m, 2).collect()}
    assert labels(mine) == labels(metric)

    draw = random.Random(8)
    vectors = [(i, [draw.random() for _ in range(20)]) for i in range(120)]
    near = neighbors.knn(spark.createDataFrame(vectors, "object_id long, v array<double>"), spark.createDataFrame(vectors[:30] + [(500, None)], "point_id long, p array<double>"), Metric("v", ("v",), 20, kernel=linf_kernel("v")), 2)
    want = {(i, r): o for i, v in vectors[:30] for r, (_, o) in enumerate(sorted((max(abs(a - b) for a, b in zip(v, w)), j) for j, w in vectors)[:2], 1)}
    assert {(r.point_id, r.rank): r.object_id for r in near.collect()} == want


def test_more_than_ten_children(spark):
    objects, metric = _segments(spark, 200), METRICS["segments2d"]
    assign, nodes = tree.build_tree(objects, metric, 30, 14, 2)
    assert assign.count() == 200 and nodes.where("is_leaf and n > 30").isEmpty()
    assert nodes.where("path rlike '[a-d]$'").count() > 0
    again = tree.assign_by_centroids(objects, nodes, metric)
    assert {(r.object_id, r.path) for r in again.collect()} == {(r.object_id, r.path) for r in assign.collect()}


@pytest.mark.parametrize("local", [20_000, 60])
def test_search_follows_the_density(spark, local):
    draw = random.Random(12)
    metric = METRICS["squares"]
    spots = lambda side: [(i, draw.uniform(0, side), draw.uniform(0, side)) for i in range(200)]
    even = [(i, draw.uniform(0, 60), draw.uniform(0, 60), 1.0, 0.0) for i in range(1200)]
    dense = [(i, *((draw.random(), draw.random()) if i % 100 else (draw.uniform(0, 100), draw.uniform(0, 100))), 0.01, 0.0) for i in range(1200)]
    alike = [(i, 5.0, 5.0, 1.0, 0.0) for i in range(500)] + [(500 + i, 5.0, 5.0 - i % 2, 1.0, 0.3) for i in range(60)]
    for rows, at, most in ((even + [(1200, 1e6, 1e6, 1.0, 0.0)], spots(60), 4), (dense, spots(1), 4), (alike + even[560:], spots(60), 200)):
        objects, points = spark.createDataFrame(rows, SQUARE), spark.createDataFrame(at, "point_id long, x double, y double")
        assert neighbors.candidates(objects, points, metric, 1, local=local).count() < most * len(at)
        assert {r.point_id: [r.object_id] for r in neighbors.nearest_neighbor(objects, points, metric, local=local).collect()} == _brute(objects, points, metric, 1)


def test_subtrees_in_one_task_are_those_of_the_levels(spark):
    objects, metric = _segments(spark, 400), METRICS["segments2d"]
    told = lambda nodes: {r.path: (r.parent, r.depth, r.n, r.is_leaf, [[round(b.lo, 9), round(b.hi, 9)] for b in r.bbox], [[round(v, 9) for v in c] for c in r.centroids or []]) for r in nodes.collect()}
    (a, wide), (b, deep), (_, mixed) = (tree.build_tree(objects, metric, 50, 3, 4, local=n) for n in (0, 50_000, 200))
    assert told(wide) == told(deep) == told(mixed)
    assert {(r.object_id, r.path) for r in a.collect()} == {(r.object_id, r.path) for r in b.collect()}
