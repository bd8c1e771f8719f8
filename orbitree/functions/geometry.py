"""Scalar geometry as Column expressions (all lengths double, all angles radians).

A vertex is struct<x,y> (or <x,y,z>). Functions take Columns and return Columns, so they stay
inside generated code and push down like any projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    parts = [x.cast("double").alias("x"), y.cast("double").alias("y")]
    return F.struct(*parts) if z is None else F.struct(*parts, z.cast("double").alias("z"))


def deg2rad_last(df: DataFrame, column: str) -> DataFrame:
    """The angle column in radians."""
    return df.withColumn(column, F.radians(column))


def square_vertices(x0: Column, y0: Column, size: Column, theta: Column) -> Column:
    """Corners of a rotated square in the order (-,-), (-,+), (+,+), (+,-)."""
    h, c, s = size / 2, F.cos(theta), F.sin(theta)
    return F.array(*(point(x0 + sx * h * c - sy * h * s, y0 + sx * h * s + sy * h * c) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))))


def square_vertices_unrotated(x0: Column, y0: Column, size: Column) -> Column:
    h = size / 2
    return F.array(*(point(x0 + sx * h, y0 + sy * h) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))))


def cuboid_vertices(x0: Column, y0: Column, z0: Column, w: Column, h: Column, d: Column) -> Column:
    """Eight axis-aligned corners around a centre, x slowest and z fastest."""
    return F.array(*(point(x0 + sx * w / 2, y0 + sy * h / 2, z0 + sz * d / 2) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)))


def rotate_point(px: Column, py: Column, rx: Column, ry: Column, degrees: Column) -> Column:
    """A point turned about a reference point."""
    a = F.radians(degrees)
    dx, dy = px - rx, py - ry
    return point(rx + dx * F.cos(a) - dy * F.sin(a), ry + dx * F.sin(a) + dy * F.cos(a))


def rotate_point3(px: Column, py: Column, pz: Column, cx: Column, cy: Column, cz: Column, angle: Column) -> Column:
    """A point turned about the vertical line through a centre; its height is relative to the centre."""
    dx, dy = px - cx, py - cy
    return point(cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle), pz - cz)


def segment_end_2d(x0: Column, y0: Column, length: Column, theta: Column) -> Column:
    return point(x0 + length * F.cos(theta), y0 + length * F.sin(theta))


def segment_end_3d(x0: Column, y0: Column, z0: Column, length: Column, theta: Column, phi: Column) -> Column:
    """The other end in spherical form: theta from the z axis, phi around it."""
    return point(x0 + length * F.sin(theta) * F.cos(phi), y0 + length * F.sin(theta) * F.sin(phi), z0 + length * F.cos(theta))


def box_to_ellipse(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """A box's width, height and centre as struct<a,b,h,k>."""
    return F.struct((x_max - x_min).alias("a"), (y_max - y_min).alias("b"), ((x_min + x_max) / 2).alias("h"), ((y_min + y_max) / 2).alias("k"))


def ellipse_box(a: Column, b: Column, h: Column, k: Column) -> Column:
    """The box whose width and height are a and b."""
    return F.struct((h - a / 2).alias("x_min"), (h + a / 2).alias("x_max"), (k - b / 2).alias("y_min"), (k + b / 2).alias("y_max"))


def vertex_mean(vertices: Column) -> Column:
    n = F.size(vertices)
    mean = lambda axis: F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[axis]) / n
    return F.when(n > 0, point(mean("x"), mean("y")))


def vertices_mbr(vertices: Column) -> Column:
    """struct<x_lo,x_hi,y_lo,y_hi> of a vertex array; null if it is empty."""
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x_lo"), F.array_max(xs).alias("x_hi"), F.array_min(ys).alias("y_lo"), F.array_max(ys).alias("y_hi"))


def polygons_unpad(vertices: Column) -> Column:
    """Vertices without the infinite padding."""
    inf = F.lit(float("inf"))
    return F.filter(vertices, lambda v: (F.abs(v["x"]) < inf) & (F.abs(v["y"]) < inf))


def polygons_pad(vertices: Column, width: Column) -> Column:
    """Vertices filled up with infinite ones to a fixed width."""
    inf = point(F.lit(float("inf")), F.lit(float("inf")))
    return F.concat(vertices, F.array_repeat(inf, F.greatest(width - F.size(vertices), F.lit(0)).cast("int")))


def path_to_int(path: Column, k: int) -> Column:
    """A node path read as digits of base k behind a leading 1."""
    return F.conv(F.concat(F.lit("1"), path), k, 10).cast("long")


def normalize_squares(df: DataFrame) -> DataFrame:
    """x and y scaled by the bounding box grown by the largest size; size by the larger extent."""
    b = df.agg(F.min("x0").alias("lx"), F.max("x0").alias("hx"), F.min("y0").alias("ly"), F.max("y0").alias("hy"), F.max("size").alias("s"))
    b = b.select((F.col("lx") - F.col("s")).alias("lx"), (F.col("hx") + F.col("s")).alias("hx"), (F.col("ly") - F.col("s")).alias("ly"), (F.col("hy") + F.col("s")).alias("hy"))
    wide, high = F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")
    return df.crossJoin(F.broadcast(b)).select("object_id", ((F.col("x0") - F.col("lx")) / wide).alias("x0"), ((F.col("y0") - F.col("ly")) / high).alias("y0"), (F.col("size") / F.greatest(wide, high)).alias("size"), "theta")


def normalize_cuboids(df: DataFrame) -> DataFrame:
    """Centres and sizes scaled per axis by the bounding box grown by that axis's largest size."""
    axes = (("x0", "w"), ("y0", "h"), ("z0", "d"))
    b = df.agg(*(F.min(c).alias(f"l{c}") for c, _ in axes), *(F.max(c).alias(f"u{c}") for c, _ in axes), *(F.max(s).alias(f"m{s}") for _, s in axes))
    lo = {c: F.col(f"l{c}") - F.col(f"m{s}") for c, s in axes}
    wide = {c: F.col(f"u{c}") + F.col(f"m{s}") - lo[c] for c, s in axes}
    return df.crossJoin(F.broadcast(b)).select("object_id", *(((F.col(c) - lo[c]) / wide[c]).alias(c) for c, _ in axes), *((F.col(s) / wide[c]).alias(s) for c, s in axes), "theta", "psi", "phi")


def normalize_ellipses(df: DataFrame) -> DataFrame:
    """Centres scaled by the box grown by the largest axes; axes by the extent of the centres."""
    b = df.agg(F.min("h").alias("lh"), F.max("h").alias("uh"), F.min("k").alias("lk"), F.max("k").alias("uk"), F.max("a").alias("ma"), F.max("b").alias("mb"))
    c = F.col
    lh, lk = c("lh") - c("ma"), c("lk") - c("mb")
    return df.crossJoin(F.broadcast(b)).select("object_id", (c("a") / (c("uh") - c("lh"))).alias("a"), (c("b") / (c("uk") - c("lk"))).alias("b"), ((c("h") - lh) / (c("uh") + c("ma") - lh)).alias("h"), ((c("k") - lk) / (c("uk") + c("mb") - lk)).alias("k"))


def normalize_polygons(df: DataFrame, scale: float = 1e-5, shift: float = 0.0) -> DataFrame:
    """Vertices scaled, moved and divided by the norm of all coordinates."""
    moved = df.withColumn("vertices", F.transform("vertices", lambda v: point(v["x"] * scale + shift, v["y"] * scale + shift)))
    norm = moved.agg(F.sqrt(F.sum(F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["x"] * v["x"] + v["y"] * v["y"]))).alias("norm"))
    return moved.crossJoin(F.broadcast(norm)).select("object_id", F.transform("vertices", lambda v: point(v["x"] / F.col("norm"), v["y"] / F.col("norm"))).alias("vertices"))
