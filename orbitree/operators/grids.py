"""Lattices over bounding boxes, decision borders and hashed samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitree.functions.metrics import METRICS, Metric
from orbitree.operators.kmeans import hashed_uniform

#: A block of a lattice is refined into blocks of this fraction of its side.
REFINE = 8


def bounding_boxes(objects: DataFrame, kind: str | Metric) -> DataFrame:
    """(path, n, bbox array<struct<lo,hi>>) per path.

    squares, cuboids, ellipses: centre range widened by the largest size of the axis on both
    sides. segments: start points less and plus the length. polygons: vertex range. A metric that isn't
    registered: the range of its boxes, or of its centres if it has none."""
    if isinstance(kind, Metric):
        if METRICS.get(kind.name) is not kind:
            sides = kind.box(kind.of()) if kind.box else [(v, v) for v in kind.centre(kind.of())]
            return objects.groupBy("path").agg(F.count("*").alias("n"), F.array(*(F.struct(F.min(lo).cast("double").alias("lo"), F.max(hi).cast("double").alias("hi")) for lo, hi in sides)).alias("bbox"))
        kind = kind.name
    c = F.col
    axes = {
        "squares": [("x0", "size"), ("y0", "size")],
        "cuboids": [("x0", "w"), ("y0", "h"), ("z0", "d")],
        "ellipses": [("h", "a"), ("k", "b")],
    }
    if kind in axes:
        spans = [F.struct((F.min(x) - F.max(s)).alias("lo"), (F.max(x) + F.max(s)).alias("hi")) for x, s in axes[kind]]
    elif kind == "polygons":
        spans = [_vertex_span("x"), _vertex_span("y")]
    else:
        names = ["x0", "y0", "z0"] if kind == "segments3d" else ["x0", "y0"]
        spans = [F.struct(F.min(c(x) - c("length")).alias("lo"), F.max(c(x) + c("length")).alias("hi")) for x in names]
    return objects.groupBy("path").agg(F.count("*").alias("n"), F.array(*spans).alias("bbox"))


def _vertex_span(axis: str) -> Column:
    values = F.transform("vertices", lambda v: v[axis])
    return F.struct(F.min(F.array_min(values)).alias("lo"), F.max(F.array_max(values)).alias("hi"))


def bbox_centers_sizes(objects: DataFrame, axes: list[tuple[str, str]]) -> DataFrame:
    """Per axis floor(min - 2 max size) and ceil(max + 2 max size), one row."""
    return objects.agg(*(x for a, s in axes for x in (F.floor(F.min(a) - 2 * F.max(s)).cast("double").alias(f"{a}_lo"), F.ceil(F.max(a) + 2 * F.max(s)).cast("double").alias(f"{a}_hi"))))


def lattice(nodes: DataFrame, per_axis: int, dim: int, last_fastest: bool = False) -> DataFrame:
    """(path, grid_id, p array<double>): per_axis**dim points over each node's bbox, the ends
    included. Axis 0 runs fastest, or the last one."""
    steps = F.sequence(F.lit(0).cast("long"), F.lit(per_axis - 1).cast("long"))
    rows = nodes.select("path", "bbox")
    for d in range(dim):
        rows = rows.withColumn(f"s{d}", F.explode(steps))
    return _spots(rows, per_axis, dim, last_fastest).select("path", "grid_id", "p")


def _spots(rows: DataFrame, per_axis: int, dim: int, last_fastest: bool = False) -> DataFrame:
    """grid_id and p of the lattice steps s0, s1, ..."""
    at = lambda d: (dim - 1 - d) if last_fastest else d
    grid_id = reduce(lambda a, b: a + b, (F.col(f"s{d}") * F.lit(per_axis ** at(d)) for d in range(dim)))
    return rows.withColumn("grid_id", grid_id).withColumn("p", F.array(*(_value(F.col(f"s{d}"), d, per_axis) for d in range(dim))))


def _value(step: Column, axis: int, per_axis: int) -> Column:
    side = F.get("bbox", F.lit(axis))
    return side["lo"] + (side["hi"] - side["lo"]) * step / F.lit(float(max(per_axis - 1, 1)))


def energies(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """points (path, p) with ``energies``: Chebyshev distance to each centroid of their path."""
    arrayed = centroids.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "c"))), lambda s: s["c"]).alias("cs"))
    near = F.transform("cs", lambda c: F.array_max(F.zip_with(c, F.col("p"), lambda a, b: F.abs(a - b))))
    return points.join(arrayed, "path").withColumn("energies", near).drop("cs")


def energy_surface(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """points with the least centroid distance and the index of that centroid."""
    rows = energies(points, centroids, k)
    return rows.withColumn("energy", F.array_min("energies")).withColumn("label", (F.array_position("energies", F.array_min("energies")) - 1).cast("long")).drop("energies")


def _scale() -> Column:
    """The longest side of a box."""
    return F.array_max(F.transform("bbox", lambda b: b["hi"] - b["lo"])).alias("scale")


def uncertainty_points(points: DataFrame, centroids: DataFrame, nodes: DataFrame, epsilon: float, dim: int, m: int, k: int = 10) -> DataFrame:
    """(path, grid_id, p, energies): lattice points near a decision border, the first m + 1 of a path.

    A rival is a centroid whose distance exceeds the least one, by at most eps = epsilon * the
    longest side of the box. With one rival, eps changes by 1 / (least * 1e-4 * 10 * dim) and is
    tested again; a least distance of 0 keeps the point. More rivals keep the point."""
    rows = energies(points, centroids, k).join(nodes.select("path", _scale()), "path").withColumn("least", F.array_min("energies")).withColumn("eps", F.col("scale") * epsilon)
    rivals = lambda eps: F.size(F.filter("energies", lambda e: (e - F.col("least") <= eps) & (e != F.col("least"))))
    n = rivals(F.col("eps"))
    narrow = F.when(F.col("least") > 0, F.col("eps") / F.when(F.col("least") > 0, F.col("least") * (0.0001 * 10 * dim))).otherwise(F.lit(float("inf")))
    kept = rows.where((n > 1) | ((n == 1) & (rivals(narrow) > 0)))
    order = Window.partitionBy("path").orderBy("grid_id")
    return kept.withColumn("row_", F.row_number().over(order)).where(F.col("row_") <= m + 1).select("path", "grid_id", "p", "energies")


def border_lattice(nodes: DataFrame, centroids: DataFrame, per_axis: int, dim: int, epsilon: float, k: int = 10) -> DataFrame:
    """The points of ``lattice`` that may be near a decision border, found by refinement.

    The lattice is cut into blocks of ever smaller sides. Within a block no distance differs from that of the middle by more
    than half its longest side r, so where the two least distances of the middle differ by more than eps + 2 r,
    no point of the block has a rival, and the block is dropped before it is refined."""
    last = F.lit(per_axis - 1)
    known = nodes.select("path", "bbox")
    rows = reduce(lambda rows, d: rows.withColumn(f"s{d}", F.lit(0).cast("long")), range(dim), known)
    wide = 1 << max(per_axis - 1, 1).bit_length()
    while wide > 1:
        fine = max(1, wide // REFINE)
        for d in range(dim):
            rows = rows.withColumn(f"s{d}", F.explode(F.sequence(F.col(f"s{d}"), F.least(F.col(f"s{d}") + (wide - 1), last.cast("long")), F.lit(fine).cast("long"))))
        wide = fine
        ends = [(_value(F.col(f"s{d}"), d, per_axis), _value(F.least(F.col(f"s{d}") + (wide - 1), last), d, per_axis)) for d in range(dim)]
        radius = F.greatest(*((hi - lo) / 2 for lo, hi in ends), F.lit(0.0))
        asked = energies(rows.withColumn("p", F.array(*((lo + hi) / 2 for lo, hi in ends))), centroids, k).withColumn("near_", F.slice(F.array_sort("energies"), 1, 2))
        gap = F.get("near_", F.lit(1)) - F.get("near_", F.lit(0))
        rows = asked.where(gap <= (_scale() * epsilon + radius * 2) * (1 + 1e-9)).select("path", "bbox", *(f"s{d}" for d in range(dim)))
    return _spots(rows, per_axis, dim).select("path", "grid_id", "p")


def random_points(nodes: DataFrame, n: int, times: int, dim: int, seed: int = 0) -> DataFrame:
    """(repeat, point_id, p): n hashed uniform points in the box of each repeat."""
    spots = nodes.select("bbox", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("repeat")).select("bbox", "repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    key = F.col("repeat") * n + F.col("i")
    value = lambda d: F.get("bbox", F.lit(d))["lo"] + (F.get("bbox", F.lit(d))["hi"] - F.get("bbox", F.lit(d))["lo"]) * hashed_uniform(key, seed + 7 * d + 1)
    return spots.select(F.col("repeat").cast("long").alias("repeat"), key.cast("long").alias("point_id"), F.array(*(value(d) for d in range(dim))).alias("p"))


def random_sample_n(objects: DataFrame, n: int, seed: int = 0, id_col: str = "object_id") -> DataFrame:
    """n objects with the least hashed numbers."""
    return objects.orderBy(hashed_uniform(F.col(id_col), seed), id_col).limit(n)


def exact_voronoi_cells(objects: DataFrame, points: DataFrame, metric: Metric, assign: DataFrame) -> DataFrame:
    """(point_id, object_id, dist, path): the leaf that owns each point's nearest object."""
    from orbitree.operators.neighbors import nearest_neighbor

    return nearest_neighbor(objects, points, metric).join(assign.select("object_id", "path"), "object_id").select("point_id", "object_id", "dist", "path")
