"""Distances between an object and a point.

Most are Column expressions. The ellipse distance has no closed form that is stable, so it is a
vectorised kernel behind a pandas UDF. ``METRICS`` is the registry that the neighbour search,
k-means and the tree use; a user adds a metric as an expression, a vectorised kernel or a plain
function (see ``Metric`` and ``metric_of``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orbitree.functions.geometry import segment_end_2d, segment_end_3d, vertices_mbr


def linf_point(a: Column, b: Column) -> Column:
    """Chebyshev distance of two vectors (arrays) of any dimension."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclid_point(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def linf_vertices(vertices: Column, px: Column, py: Column) -> Column:
    """Least Chebyshev distance to given vertices; infinite if there are none."""
    near = F.array_min(F.transform(vertices, lambda v: F.greatest(F.abs(v["x"] - px), F.abs(v["y"] - py))))
    return F.coalesce(near, F.lit(float("inf")))


def _corners(x0: Column, y0: Column, size: Column, theta: Column) -> list[tuple[Column, Column]]:
    """Corners as scalar columns, which keeps the metric inside generated code."""
    h, c, s = size / 2, F.cos(theta), F.sin(theta)
    return [(x0 + sx * h * c - sy * h * s, y0 + sx * h * s + sy * h * c) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))]


def linf_square(x0: Column, y0: Column, size: Column, theta: Column, px: Column, py: Column) -> Column:
    """0 inside (even-odd rule), else the least Chebyshev distance to a corner (an over-estimate
    along edges)."""
    corners = _corners(x0, y0, size, theta)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        cross = ax + (py - ay) * (bx - ax) / F.when(ay != by, by - ay)
        hit = (py > F.least(ay, by)) & (py <= F.greatest(ay, by)) & (px <= F.greatest(ax, bx)) & ((ax == bx) | (px <= cross))
        crossings = crossings + F.when(hit, 1).otherwise(0)
    near = F.least(*(F.greatest(F.abs(x - px), F.abs(y - py)) for x, y in corners))
    return F.when(crossings % 2 == 1, 0.0).otherwise(near)


def linf_square_exact(x0: Column, y0: Column, size: Column, theta: Column, px: Column, py: Column) -> Column:
    """Chebyshev distance to the square's boundary (not 0 inside).

    Along an edge the larger of |x| and |y| is least at an end or where the edge crosses a
    diagonal through the point; crossings outside the edge are moved to its ends."""
    corners = [(x - px, y - py) for x, y in _corners(x0, y0, size, theta)]
    tries = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        dx, dy = bx - ax, by - ay
        for t in (F.lit(0.0), _ratio(ay - ax, dx - dy), _ratio(-ay - ax, dx + dy)):
            t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
            tries.append(F.greatest(F.abs(ax + t * dx), F.abs(ay + t * dy)))
    return F.least(*tries)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(F.abs(b) > 1e-300, b), F.lit(0.0))


def linf_cuboid(x0: Column, y0: Column, z0: Column, w: Column, h: Column, d: Column, px: Column, py: Column, pz: Column) -> Column:
    """1e-7 strictly inside. Outside in x: the largest face distance of the three axes; else outside
    in y: of y and z; else of z. An axis within range still counts its nearer face there."""

    def axis(centre: Column, width: Column, p: Column) -> tuple[Column, Column]:
        lo, hi = centre - width / 2 - p, centre + width / 2 - p
        return lo * hi < 0, F.least(F.abs(lo), F.abs(hi))

    (in_x, fx), (in_y, fy), (in_z, fz) = axis(x0, w, px), axis(y0, h, py), axis(z0, d, pz)
    return F.when(~in_x, F.greatest(fx, fy, fz)).when(~in_y, F.greatest(fy, fz)).when(~in_z, fz).otherwise(1e-7)


def linf_cuboid_exact(x0: Column, y0: Column, z0: Column, w: Column, h: Column, d: Column, px: Column, py: Column, pz: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(*(F.greatest(F.abs(c - p) - s / 2, zero) for c, s, p in ((x0, w, px), (y0, h, py), (z0, d, pz))))


def _clamped(dot: Column, len2: Column) -> Column:
    return F.least(F.greatest(F.coalesce(dot / F.when(len2 > 0, len2), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def edge_dist(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean distance to a segment between two points; to the point if it has no length."""
    dx, dy = bx - ax, by - ay
    t = _clamped((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    return euclid_point(px, py, ax + t * dx, ay + t * dy)


def segment_dist_2d(x0: Column, y0: Column, length: Column, theta: Column, px: Column, py: Column) -> Column:
    end = segment_end_2d(x0, y0, length, theta)
    return edge_dist(px, py, x0, y0, end["x"], end["y"])


def segment_dist_3d(x0: Column, y0: Column, z0: Column, length: Column, theta: Column, phi: Column, px: Column, py: Column, pz: Column) -> Column:
    end = segment_end_3d(x0, y0, z0, length, theta, phi)
    d = [(end["x"] - x0, px - x0), (end["y"] - y0, py - y0), (end["z"] - z0, pz - z0)]
    t = _clamped(sum((v * q for v, q in d[1:]), d[0][0] * d[0][1]), sum((v * v for v, _ in d[1:]), d[0][0] * d[0][0]))
    return F.sqrt(sum(((q - t * v) * (q - t * v) for v, q in d[1:]), (d[0][1] - t * d[0][0]) * (d[0][1] - t * d[0][0])))


def polygon_dist(vertices: Column, px: Column, py: Column) -> Column:
    """Euclidean distance to the boundary; infinite for no vertices."""
    n = F.size(vertices)
    ring = F.arrays_zip(vertices.alias("p"), F.concat(F.slice(vertices, 2, F.greatest(n - 1, F.lit(0))), F.slice(vertices, 1, 1)).alias("q"))
    near = F.array_min(F.transform(ring, lambda e: edge_dist(px, py, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))
    return F.coalesce(near, F.lit(float("inf")))


def box_dist(x_min: Column, x_max: Column, y_min: Column, y_max: Column, px: Column, py: Column) -> Column:
    """Per axis -1 strictly inside, else the nearer face; the larger of both."""
    axis = lambda lo, hi, p: F.when((lo < p) & (p < hi), -1.0).otherwise(F.least(F.abs(p - lo), F.abs(p - hi)))
    return F.greatest(axis(x_min, x_max, px), axis(y_min, y_max, py))


def ellipse_kernel(a: np.ndarray, b: np.ndarray, dx: np.ndarray, dy: np.ndarray, steps: int = 80) -> np.ndarray:
    """Euclidean distance from (dx, dy) to the curve with semi-axes a, b around the origin.

    In the first quadrant the foot point is (a^2 u/(t+a^2), b^2 v/(t+b^2)) for the root t of a
    function that falls with t; bisection on it is safe for circles, axis points and the centre."""
    long = np.maximum(a, b)
    short = np.minimum(a, b)
    u = np.abs(np.where(a >= b, dx, dy))
    v = np.abs(np.where(a >= b, dy, dx))
    with np.errstate(divide="ignore", invalid="ignore"):
        lo = -short * short + short * v
        hi = -short * short + np.hypot(long * u, short * v)
        for _ in range(steps):
            t = (lo + hi) / 2
            value = (long * u / (t + long * long)) ** 2 + (short * v / (t + short * short)) ** 2 - 1
            lo, hi = np.where(value > 0, t, lo), np.where(value > 0, hi, t)
        t = (lo + hi) / 2
        x = long * long * u / (t + long * long)
        y = short * short * v / (t + short * short)
        # on the long axis close to the centre the foot point leaves the axis
        gap = long * long - short * short
        inner = (v == 0) & (long * u < gap)
        x = np.where(inner, long * long * u / np.where(gap > 0, gap, 1), x)
        x = np.where((v == 0) & ~inner, long, x)
        x = np.clip(np.nan_to_num(x), 0, long)
        y = np.where(v == 0, short * np.sqrt(np.clip(1 - (x / long) ** 2, 0, 1)), y)
    return np.hypot(x - u, y - v)


@F.pandas_udf(DoubleType())
def _ellipse_udf(a: pd.Series, b: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    return pd.Series(ellipse_kernel(a.to_numpy(float), b.to_numpy(float), dx.to_numpy(float), dy.to_numpy(float)))


def ellipse_dist(a: Column, b: Column, h: Column, k: Column, px: Column, py: Column) -> Column:
    """Euclidean distance to the curve, semi-axes a and b (positive inside too)."""
    return _ellipse_udf(a, b, px - h, py - k)


#: Dimensions up to which vectors are searched by pivots.
PIVOT_DIM = 16

Kernel = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Metric:
    """A distance between objects and points for the operators.

    distance(object columns, point columns) gives the distance as a Column, or kernel(arrays of n
    objects by column, array of m points x dim) gives it as an n x m matrix; one of them is enough
    (see ``metric_of`` for a plain function). box(object columns) gives (lo, hi) per axis; the
    distance is never less than the Chebyshev distance to that box. anchor gives a point from which
    the Euclidean distance to a point is never less than the metric. Without box and anchor,
    neighbours are found by pivots if between(m points, n points) gives the most that the metric can change
    between two points (for a distance to a set, the distance of the points), else by comparing blocks. centre gives the point that stands for an object in
    means; clustering needs it. With shape and pairs a search tells within its tasks which pairs are near: shape gives an array of
    numbers, pairs(n rows of these numbers, n points x dim) n distances by the very operations of ``distance``. Shorter arrays end in NaN."""

    name: str
    columns: tuple[str, ...]
    dim: int
    distance: Callable[[dict[str, Column], list[Column]], Column] | None = None
    box: Callable[[dict[str, Column]], list[tuple[Column, Column]]] | None = None
    anchor: Callable[[dict[str, Column]], list[Column]] | None = None
    centre: Callable[[dict[str, Column]], list[Column]] | None = None
    kernel: Kernel | None = None
    between: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    shape: Callable[[dict[str, Column]], Column] | None = None
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def __post_init__(self) -> None:
        if self.distance is None and self.kernel is None:
            raise ValueError("a metric needs a distance or a kernel")
        if self.distance is None:
            object.__setattr__(self, "distance", _by_kernel(self))

    @property
    def axes(self) -> tuple[str, ...]:
        """Columns of a point: x, y, z, or one array p in more dimensions."""
        return ("x", "y", "z")[: self.dim] if self.dim <= 3 else ("p",)

    def at(self, point: Column) -> list[Column]:
        """The coordinates of an array as ``distance`` takes them: one column an axis, or the array itself."""
        return [F.get(point, F.lit(i)) for i in range(self.dim)] if self.dim <= 3 else [point]

    def of(self, prefix: str = "") -> dict[str, Column]:
        return {c: F.col(prefix + c) for c in self.columns}

    def matrix(self, objects: dict[str, pd.Series], points: np.ndarray) -> np.ndarray:
        """Distances of n objects to m points, by the kernel."""
        if self.kernel is None:
            raise ValueError(f"the metric {self.name} has no bounds, so it needs a kernel")
        return np.asarray(self.kernel({c: _stacked(v) for c, v in objects.items()}, points), dtype=float)


def _stacked(values: pd.Series) -> np.ndarray:
    """A column as an array; arrays of one length become a matrix."""
    if len(values) and values.dtype == object and len({np.size(v) for v in values}) == 1 and np.ndim(values.iloc[0]) == 1 and np.asarray(values.iloc[0]).dtype != object:
        return np.array(values.tolist(), dtype=float)
    return values.to_numpy()


def _by_kernel(metric: Metric) -> Callable[[dict[str, Column], list[Column]], Column]:
    """The kernel as a Column: one call for each different point of a batch."""

    def rows(objects: pd.DataFrame, points: pd.Series) -> pd.Series:
        out = np.full(len(points), np.nan)
        known = np.flatnonzero(points.map(lambda p: p is not None and not any(v is None or v != v for v in p)))
        if len(known):
            different, which = np.unique(np.array(points.iloc[known].tolist(), dtype=float), axis=0, return_inverse=True)
            for i, point in enumerate(different):
                at = known[which.ravel() == i]
                out[at] = metric.matrix({c: objects[c].iloc[at] for c in metric.columns}, point[None])[:, 0]
        return pd.Series(out).where(~np.isnan(out), None)


    def distance(o: dict[str, Column], p: list[Column]) -> Column:
        point = p[0] if metric.dim > 3 and len(p) == 1 else F.array(*p)
        return F.pandas_udf(rows, DoubleType())(F.struct(*(v.alias(c) for c, v in o.items())), point)

    return distance


def metric_of(name: str, columns: tuple[str, ...], dim: int, function: Callable[[np.ndarray, np.ndarray], float], **bounds: Callable) -> Metric:
    """A metric from a plain function of one object (its columns as an array) and one point."""

    def kernel(objects: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
        entries = np.column_stack([objects[c] for c in columns])
        return np.array([[function(e, p) for p in points] for e in entries], dtype=float).reshape(len(entries), len(points))

    return Metric(name, columns, dim, kernel=kernel, **bounds)


def linf_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chebyshev distances of m points to n points."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, d, None] - b[None, :, d]), out=out)
    return out


def euclid_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of m points to n points."""
    return np.sqrt(sum((a[:, d, None] - b[None, :, d]) ** 2 for d in range(a.shape[1])))


def linf_kernel(column: str) -> Kernel:
    """Chebyshev distance of vectors in a column of arrays."""

    def kernel(objects: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
        vectors = objects[column]
        out = np.zeros((len(vectors), len(points)))
        for d in range(points.shape[1]):
            np.maximum(out, np.abs(vectors[:, d, None] - points[None, :, d]), out=out)
        return out

    return kernel


def vector_metric(column: str, dim: int, name: str = "vectors") -> Metric:
    """Chebyshev distance of vectors in a column of arrays, for search, means and trees in any dimension.
    Beyond ``PIVOT_DIM`` dimensions distances differ too little for pivots, so blocks are compared."""
    each = lambda o: [F.get(o[column], F.lit(i)).cast("double") for i in range(dim)]
    point = lambda p: p[0] if len(p) == 1 else F.array(*p)
    return Metric(name, (column,), dim, lambda o, p: linf_point(o[column], point(p)), lambda o: [(v, v) for v in each(o)], each, each, linf_kernel(column), linf_between if dim <= PIVOT_DIM else None)


def _square_box(o: dict[str, Column]) -> list[tuple[Column, Column]]:
    reach = o["size"] / 2 * (F.abs(F.cos(o["theta"])) + F.abs(F.sin(o["theta"])))
    return [(o["x0"] - reach, o["x0"] + reach), (o["y0"] - reach, o["y0"] + reach)]


def _square_corner(o: dict[str, Column]) -> list[Column]:
    return list(_corners(o["x0"], o["y0"], o["size"], o["theta"])[0])


def _ends(o: dict[str, Column]) -> list[tuple[Column, Column]]:
    if "z0" in o:
        e = segment_end_3d(o["x0"], o["y0"], o["z0"], o["length"], o["theta"], o["phi"])
        return [(o["x0"], e["x"]), (o["y0"], e["y"]), (o["z0"], e["z"])]
    e = segment_end_2d(o["x0"], o["y0"], o["length"], o["theta"])
    return [(o["x0"], e["x"]), (o["y0"], e["y"])]


def segment_kernel(o: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """Euclidean distance of segments in two or three dimensions; one without length is a point."""
    if "z0" in o:
        way = np.column_stack([np.sin(o["theta"]) * np.cos(o["phi"]), np.sin(o["theta"]) * np.sin(o["phi"]), np.cos(o["theta"])])
        start = np.column_stack([o["x0"], o["y0"], o["z0"]])
    else:
        way = np.column_stack([np.cos(o["theta"]), np.sin(o["theta"])])
        start = np.column_stack([o["x0"], o["y0"]])
    way = way * np.asarray(o["length"], dtype=float)[:, None]
    length2 = (way * way).sum(1)
    ahead = sum((points[None, :, d] - start[:, d, None]) * way[:, d, None] for d in range(points.shape[1]))
    t = np.clip(ahead / np.where(length2 > 0, length2, 1.0)[:, None], 0.0, 1.0)
    return np.sqrt(sum((points[None, :, d] - start[:, d, None] - t * way[:, d, None]) ** 2 for d in range(points.shape[1])))


def _segment(name: str, columns: tuple[str, ...], dim: int, distance: Callable[..., Column]) -> Metric:
    return Metric(
        name,
        columns,
        dim,
        lambda o, p: distance(*(o[c] for c in columns), *p),
        lambda o: [(F.least(a, b), F.greatest(a, b)) for a, b in _ends(o)],
        lambda o: [a for a, _ in _ends(o)],
        lambda o: [(a + b) / 2 for a, b in _ends(o)],
        segment_kernel,
        shape=lambda o: F.array(*(a for a, _ in _ends(o)), *(b for _, b in _ends(o))),
        pairs=segment_pairs,
    )


def _ring_box(o: dict[str, Column]) -> list[tuple[Column, Column]]:
    m = vertices_mbr(o["vertices"])
    return [(m["x_lo"], m["x_hi"]), (m["y_lo"], m["y_hi"])]


def _mean(vertices: Column, axis: str) -> Column:
    return F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[axis]) / F.size(vertices)


def square_pairs(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``linf_square`` of corners x0, y0, x1, ... and points."""
    corners = [(shape[:, 2 * i], shape[:, 2 * i + 1]) for i in range(4)]
    px, py = p[:, 0], p[:, 1]
    crossings = np.zeros(len(p), dtype=np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            cross = ax + (py - ay) * (bx - ax) / np.where(ay != by, by - ay, np.nan)
            crossings += (py > np.minimum(ay, by)) & (py <= np.maximum(ay, by)) & (px <= np.maximum(ax, bx)) & ((ax == bx) | (px <= cross))
    near = np.minimum.reduce([np.maximum(np.abs(x - px), np.abs(y - py)) for x, y in corners])
    return np.where(crossings % 2 == 1, 0.0, near)


def cuboid_pairs(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``linf_cuboid`` of x0, y0, z0, w, h, d and points."""
    lo, hi = shape[:, :3] - shape[:, 3:6] / 2 - p, shape[:, :3] + shape[:, 3:6] / 2 - p
    inside, face = lo * hi < 0, np.minimum(np.abs(lo), np.abs(hi))
    return np.select([~inside[:, 0], ~inside[:, 1], ~inside[:, 2]], [face.max(1), face[:, 1:].max(1), face[:, 2]], 1e-7)


def _edge_pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    way, ahead = b - a, p - a
    length2, dot = sum((way[:, i] * way[:, i] for i in range(1, way.shape[1])), way[:, 0] * way[:, 0]), sum((ahead[:, i] * way[:, i] for i in range(1, way.shape[1])), ahead[:, 0] * way[:, 0])
    t = np.minimum(np.maximum(np.where(length2 > 0, dot / np.where(length2 > 0, length2, 1.0), 0.0), 0.0), 1.0)
    gap = p - (a + t[:, None] * way) if way.shape[1] == 2 else ahead - t[:, None] * way
    return np.sqrt(sum((gap[:, i] * gap[:, i] for i in range(1, way.shape[1])), gap[:, 0] * gap[:, 0]))


def segment_pairs(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of segments, given by both ends, and points."""
    return _edge_pairs(shape[:, : p.shape[1]], shape[:, p.shape[1] :], p)


def polygon_pairs(shape: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``polygon_dist`` of vertices x0, y0, x1, ... and points."""
    near, last = np.full(len(p), np.inf), shape[:, :2]
    n = shape.shape[1] // 2
    for i in range(n):
        at = np.flatnonzero(~np.isnan(shape[:, 2 * i]))
        after = shape[at, 2 * i + 2 : 2 * i + 4] if i + 1 < n else last[at]
        after = np.where(np.isnan(after), last[at], after)
        near[at] = np.minimum(near[at], _edge_pairs(shape[at, 2 * i : 2 * i + 2], after, p[at]))
    return near


METRICS: dict[str, Metric] = {
    "squares": Metric("squares", ("x0", "y0", "size", "theta"), 2, lambda o, p: linf_square(o["x0"], o["y0"], o["size"], o["theta"], *p), _square_box, _square_corner, lambda o: [o["x0"], o["y0"]], shape=lambda o: F.array(*(v for corner in _corners(o["x0"], o["y0"], o["size"], o["theta"]) for v in corner)), pairs=square_pairs),
    "cuboids": Metric(
        "cuboids",
        ("x0", "y0", "z0", "w", "h", "d"),
        3,
        lambda o, p: linf_cuboid(*(o[c] for c in ("x0", "y0", "z0", "w", "h", "d")), *p),
        lambda o: [(o[c] - o[s] / 2, o[c] + o[s] / 2) for c, s in (("x0", "w"), ("y0", "h"), ("z0", "d"))],
        lambda o: [o[c] + o[s] / 2 for c, s in (("x0", "w"), ("y0", "h"), ("z0", "d"))],
        lambda o: [o["x0"], o["y0"], o["z0"]],
        shape=lambda o: F.array(*(o[c] for c in ("x0", "y0", "z0", "w", "h", "d"))),
        pairs=cuboid_pairs,
    ),
    "ellipses": Metric(
        "ellipses",
        ("a", "b", "h", "k"),
        2,
        lambda o, p: ellipse_dist(o["a"], o["b"], o["h"], o["k"], *p),
        lambda o: [(o["h"] - o["a"], o["h"] + o["a"]), (o["k"] - o["b"], o["k"] + o["b"])],
        lambda o: [o["h"] + o["a"], o["k"]],
        lambda o: [o["h"], o["k"]],
    ),
    "segments2d": _segment("segments2d", ("x0", "y0", "length", "theta"), 2, segment_dist_2d),
    "segments3d": _segment("segments3d", ("x0", "y0", "z0", "length", "theta", "phi"), 3, segment_dist_3d),
    "polygons": Metric("polygons", ("vertices",), 2, lambda o, p: polygon_dist(o["vertices"], *p), _ring_box, lambda o: [F.get(o["vertices"], F.lit(0))["x"], F.get(o["vertices"], F.lit(0))["y"]], lambda o: [_mean(o["vertices"], "x"), _mean(o["vertices"], "y")], shape=lambda o: F.flatten(F.transform(o["vertices"], lambda v: F.array(v["x"], v["y"]))), pairs=polygon_pairs),
}
