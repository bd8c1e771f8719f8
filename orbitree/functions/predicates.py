"""Geometric predicates as Column expressions. Vertices are struct<x,y>; boxes are centre and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _divided(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def point_in_polygon(px: Column, py: Column, vertices: Column) -> Column:
    """Even-odd ray cast: an edge counts for y_min < y <= y_max and x at or left of the crossing."""
    n = F.size(vertices)
    ring = F.arrays_zip(vertices.alias("p"), F.concat(F.slice(vertices, 2, F.greatest(n - 1, F.lit(0))), F.slice(vertices, 1, 1)).alias("q"))

    def hit(e: Column) -> Column:
        p, q = e["p"], e["q"]
        cross = p["x"] + _divided((py - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        inside = (py > F.least(p["y"], q["y"])) & (py <= F.greatest(p["y"], q["y"])) & (px <= F.greatest(p["x"], q["x"]))
        return inside & ((p["x"] == q["x"]) | (px <= cross))

    return F.when(n < 3, False).otherwise(F.size(F.filter(ring, hit)) % 2 == 1)


def aabb_overlap_2d(ax: Column, ay: Column, asize: Column, bx: Column, by: Column, bsize: Column) -> Column:
    """Closed overlap of axis-aligned squares around their centres; touching counts."""
    reach = (asize + bsize) / 2
    return (F.abs(ax - bx) <= reach) & (F.abs(ay - by) <= reach)


def aabb_overlap_3d(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed overlap of cuboids (x, y, z, w, h, d)."""
    out = F.lit(True)
    for i in range(3):
        out = out & (F.abs(a[i] - b[i]) <= (a[i + 3] + b[i + 3]) / 2)
    return out


def corner_box_overlap(ax: Column, ay: Column, asize: Column, bx: Column, by: Column, bsize: Column) -> Column:
    """Strict overlap of boxes [x, x + size) given by their corner."""
    return (ax < bx + bsize) & (bx < ax + asize) & (ay < by + bsize) & (by < ay + asize)


def point_in_box(x: Column, y: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    return (x > x_min) & (x < x_max) & (y > y_min) & (y < y_max)


def segments_intersect_param(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Crossing parameters both in [0, 1]; parallel segments don't intersect."""
    rx, ry, sx, sy = p2["x"] - p1["x"], p2["y"] - p1["y"], p4["x"] - p3["x"], p4["y"] - p3["y"]
    den = rx * sy - ry * sx
    qx, qy = p3["x"] - p1["x"], p3["y"] - p1["y"]
    t, u = _divided(qx * sy - qy * sx, den), _divided(qx * ry - qy * rx, den)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def _turn(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["y"] - p["y"]) * (r["x"] - q["x"]) - (q["x"] - p["x"]) * (r["y"] - q["y"]))


def _on(p: Column, q: Column, r: Column) -> Column:
    """q within the box of p and r."""
    return q["x"].between(F.least(p["x"], r["x"]), F.greatest(p["x"], r["x"])) & q["y"].between(F.least(p["y"], r["y"]), F.greatest(p["y"], r["y"]))


def segments_intersect_orient(p1: Column, q1: Column, p2: Column, q2: Column) -> Column:
    """Orientation test, collinear touching included."""
    a, b, c, d = _turn(p1, q1, p2), _turn(p1, q1, q2), _turn(p2, q2, p1), _turn(p2, q2, q1)
    return ((a != b) & (c != d)) | ((a == 0) & _on(p1, p2, q1)) | ((b == 0) & _on(p1, q2, q1)) | ((c == 0) & _on(p2, p1, q2)) | ((d == 0) & _on(p2, q1, q2))


def vertex_intersect(a: Column, b: Column) -> Column:
    """A vertex of one ring lies inside the other."""
    return F.exists(a, lambda v: point_in_polygon(v["x"], v["y"], b)) | F.exists(b, lambda v: point_in_polygon(v["x"], v["y"], a))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1)).alias("q"))


def edge_intersect(a: Column, b: Column) -> Column:
    """Edges of the rings cross, or a vertex lies inside."""
    cross = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: segments_intersect_param(e["p"], e["q"], f["p"], f["q"])))
    return cross | vertex_intersect(a, b)


def cuboids_edge_intersect(a: Column, b: Column) -> Column:
    """Any line between two corners of one cuboid crosses any of the other, seen from above."""
    return F.exists(_lines(a), lambda e: F.exists(_lines(b), lambda f: segments_intersect_orient(e["p"], e["q"], f["p"], f["q"])))


def _lines(corners: Column) -> Column:
    """All pairs of the eight corners."""
    return F.array(*(F.struct(F.get(corners, F.lit(i)).alias("p"), F.get(corners, F.lit(j)).alias("q")) for i in range(8) for j in range(i + 1, 8)))
