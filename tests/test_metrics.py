from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitree.functions import geometry as g
from orbitree.functions import metrics as m
from orbitree.functions import predicates as p


def test_ellipse_kernel_against_dense_curve():
    draw = random.Random(1)
    a, b, x, y = (np.array([f() for _ in range(300)]) for f in (lambda: draw.uniform(0.5, 4), lambda: draw.uniform(0.5, 4), lambda: draw.uniform(-6, 6), lambda: draw.uniform(-6, 6)))
    a[:20] = b[:20]
    x[20:40] = 0
    y[40:60] = 0
    x[60:65] = y[60:65] = 0
    t = np.linspace(0, 2 * np.pi, 20001)
    exact = np.array([np.hypot(a[i] * np.cos(t) - x[i], b[i] * np.sin(t) - y[i]).min() for i in range(300)])
    assert np.abs(m.ellipse_kernel(a, b, x, y) - exact).max() < 2e-3


def _one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_square_metrics(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    inside, edge, out = _one(spark, m.linf_square(*lit(0, 0, 2, 0, 0.5, 0.5)), m.linf_square(*lit(0, 0, 2, 0, 0, 1)), m.linf_square(*lit(0, 0, 2, 0, 3, 0)))
    assert (inside, edge, out) == (0.0, 0.0, 2.0)
    near, mid = _one(spark, m.linf_square_exact(*lit(0, 0, 2, 0, 3, 0)), m.linf_square_exact(*lit(0, 0, 2, 0, 0, 0)))
    assert (near, mid) == (2.0, 1.0)
    diamond = _one(spark, m.linf_square_exact(*lit(0, 0, math.sqrt(2), math.pi / 4, 1, 1)))[0]
    assert diamond == pytest.approx(0.5)


def test_cuboid_branches(spark):
    at = lambda *q: m.linf_cuboid(*(F.lit(float(v)) for v in (0, 0, 0, 2, 2, 2, *q)))
    assert tuple(_one(spark, at(0, 0, 0), at(0, 0, 3), at(0, 3, 0), at(3, 0, 0), at(1, 0.5, 0.5))) == (1e-7, 2.0, 2.0, 2.0, 0.5)


def test_degenerate_shapes(spark):
    zero = m.segment_dist_2d(*(F.lit(float(v)) for v in (0, 0, 0, 1, 3, 4)))
    zero3 = m.segment_dist_3d(*(F.lit(float(v)) for v in (0, 0, 0, 0, 1, 1, 2, 3, 6)))
    none = F.array().cast("array<struct<x:double,y:double>>")
    ring = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    row = _one(spark, zero, zero3, m.polygon_dist(none, F.lit(0.0), F.lit(0.0)), m.polygon_dist(ring, F.lit(2.0), F.lit(1.0)), p.point_in_polygon(F.lit(2.0), F.lit(1.0), ring), p.point_in_polygon(F.lit(5.0), F.lit(1.0), ring))
    assert tuple(row) == (5.0, 7.0, float("inf"), 1.0, True, False)


def test_padding_and_paths(spark):
    ring = F.array(*(g.point(F.lit(float(i)), F.lit(1.0)) for i in range(3)))
    row = _one(spark, F.size(g.polygons_pad(ring, F.lit(10))), F.size(g.polygons_unpad(g.polygons_pad(ring, F.lit(10)))), g.path_to_int(F.lit("021"), 3))
    assert tuple(row) == (10, 3, 34)


def test_segments_touching(spark):
    pt = lambda x, y: g.point(F.lit(float(x)), F.lit(float(y)))
    collinear = (pt(0, 0), pt(2, 0), pt(1, 0), pt(3, 0))
    crossing = (pt(0, 0), pt(2, 2), pt(0, 2), pt(2, 0))
    row = _one(spark, p.segments_intersect_param(*collinear), p.segments_intersect_orient(*collinear), p.segments_intersect_param(*crossing), p.segments_intersect_orient(*crossing))
    assert tuple(row) == (False, True, True, True)


def test_box_distance_bounds_every_metric(spark):
    """No metric is below the Chebyshev distance to the object's box, nor above the distance to its anchor."""
    rows = [(i, *(random.Random(i * 7 + j).uniform(0.5, 3) for j in range(4)), random.Random(i).uniform(-9, 9), random.Random(i + 1).uniform(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "object_id long, p double, q double, r double, s double, x double, y double")
    names = {"squares": ("x0", "y0", "size", "theta"), "segments2d": ("x0", "y0", "length", "theta"), "ellipses": ("a", "b", "h", "k")}
    for kind, columns in names.items():
        metric = m.METRICS[kind]
        o = dict(zip(columns, map(F.col, "pqrs")))
        gap = F.greatest(*(F.greatest(lo - q, q - hi, F.lit(0.0)) for (lo, hi), q in zip(metric.box(o), (F.col("x"), F.col("y")))))
        anchor = metric.anchor(o)
        far = m.euclid_point(F.col("x"), F.col("y"), anchor[0], anchor[1])
        dist = metric.distance(o, [F.col("x"), F.col("y")])
        assert df.where((dist < gap - 1e-9) | (dist > far + 1e-9)).count() == 0
