"""Registered queries of the geometric operators, with their oracle SQL.

Every query reads whole tables. Distances are rounded to 6 digits for comparison, since the
engines' sine and cosine differ in the last bit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitree.functions import geometry as g
from orbitree.functions import metrics as m
from orbitree.functions import predicates as p
from orbitree.operators import accuracy, grids, kmeans, neighbors, overlap, router, tree
from orbitree.operators.overlap import cuboid_boxes, square_boxes
from orbitree.plans.fixtures import SQL, fixture, with_sql
from orbitree.storage import materialize, shared_dir

FLAGSHIP = "nearest_neighbor"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from orbitree.plans import fixed_tree

    return _QUERIES | fixed_tree.QUERIES


def oracle_sql() -> dict[str, str]:
    from orbitree.plans import fixed_tree

    return _ORACLE | fixed_tree.ORACLE


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


c = F.col

# --- pairs: points and objects dealt to each other, so that both tables are read whole --------


def _ids_sql(objects: str, points: str) -> str:
    return f"ids AS (SELECT i % n_o AS object_id, i % n_p AS point_id FROM (SELECT n_o, n_p, unnest(range(greatest(n_o, n_p))) AS i FROM (SELECT (SELECT count(DISTINCT object_id) FROM {objects}) AS n_o, (SELECT count(*) FROM {points}) AS n_p)))"


def _pairs(spark: SparkSession, sf_dir: str, objects: str, points: str = "points2d") -> DataFrame:
    """As many pairs as the larger table has rows; ids run from 0 without gaps."""
    o, q = fixture(spark, sf_dir, objects), fixture(spark, sf_dir, points)
    n_o, n_p = o.count(), q.count()
    ids = spark.range(max(n_o, n_p) if n_o and n_p else 0).select((c("id") % max(n_o, 1)).alias("object_id"), (c("id") % max(n_p, 1)).alias("point_id"))
    return ids.join(q, "point_id").join(o, "object_id")


def _pair_sql(objects: str, select: str, points: str = "points2d", extra: str = "") -> str:
    return f"{with_sql(points, objects)}, {_ids_sql(objects, points)}, pairs AS (SELECT * FROM ids JOIN {points} USING (point_id) JOIN {objects} USING (object_id)){extra} SELECT object_id, {select} FROM pairs"


def _corner(i: int, cx: str = "x0", cy: str = "y0", size: str = "size", theta: str = "theta") -> tuple[str, str]:
    sx, sy = ((-1, -1), (-1, 1), (1, 1), (1, -1))[i]
    return f"({cx} + {sx} * {size} / 2 * cos({theta}) - {sy} * {size} / 2 * sin({theta}))", f"({cy} + {sx} * {size} / 2 * sin({theta}) + {sy} * {size} / 2 * cos({theta}))"


def _inside_sql(px: str, py: str, corners: list[tuple[str, str]]) -> str:
    """Even-odd rule over corners."""
    hits = []
    for i, (ax, ay) in enumerate(corners):
        bx, by = corners[(i + 1) % len(corners)]
        hits.append(f"CASE WHEN {py} > least({ay}, {by}) AND {py} <= greatest({ay}, {by}) AND {px} <= greatest({ax}, {bx}) AND ({ax} = {bx} OR {px} <= {ax} + ({py} - {ay}) * ({bx} - {ax}) / ({by} - {ay})) THEN 1 ELSE 0 END")
    return f"(({' + '.join(hits)}) % 2 = 1)"


_CORNERS = [_corner(i) for i in range(4)]
_CORNER_DIST = "least(" + ", ".join(f"greatest(abs({cx} - x), abs({cy} - y))" for cx, cy in _CORNERS) + ")"
_LINF_SQUARE = f"CASE WHEN {_inside_sql('x', 'y', _CORNERS)} THEN CAST(0 AS DOUBLE) ELSE {_CORNER_DIST} END"


def _edge_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    len2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"least(greatest(COALESCE((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / NULLIF({len2}, 0), 0), 0), 1)"
    return f"sqrt(({px} - {ax} - {t} * ({bx} - {ax})) ** 2 + ({py} - {ay} - {t} * ({by} - {ay})) ** 2)"


_SEG2 = _edge_sql("x", "y", "x0", "y0", "(x0 + length * cos(theta))", "(y0 + length * sin(theta))")
_D3 = ("(length * sin(theta) * cos(phi))", "(length * sin(theta) * sin(phi))", "(length * cos(theta))")
_T3 = f"least(greatest(COALESCE(((x - x0) * {_D3[0]} + (y - y0) * {_D3[1]} + (z - z0) * {_D3[2]}) / NULLIF({_D3[0]} ** 2 + {_D3[1]} ** 2 + {_D3[2]} ** 2, 0), 0), 0), 1)"
_SEG3 = f"sqrt((x - x0 - {_T3} * {_D3[0]}) ** 2 + (y - y0 - {_T3} * {_D3[1]}) ** 2 + (z - z0 - {_T3} * {_D3[2]}) ** 2)"


def _face(centre: str, size: str, q: str) -> tuple[str, str]:
    return f"({centre} - {size} / 2 - {q}) * ({centre} + {size} / 2 - {q}) < 0", f"least(abs({centre} - {size} / 2 - {q}), abs({centre} + {size} / 2 - {q}))"


_FX, _FY, _FZ = _face("x0", "w", "x"), _face("y0", "h", "y"), _face("z0", "d", "z")
_LINF_CUBOID = f"CASE WHEN NOT ({_FX[0]}) THEN greatest({_FX[1]}, {_FY[1]}, {_FZ[1]}) WHEN NOT ({_FY[0]}) THEN greatest({_FY[1]}, {_FZ[1]}) WHEN NOT ({_FZ[0]}) THEN {_FZ[1]} ELSE CAST(0.0000001 AS DOUBLE) END"
_EDGES = f"""edges AS (SELECT a.object_id, a.i, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM vertices a JOIN vertices b ON a.object_id = b.object_id AND b.i = (a.i + 1) % a.m)"""

def _uniform_sql(key: str, seed: int) -> str:
    return f"((({key} % 1000003 * 48271 + {seed * 69621 + 12345}) % 2147483647 * 16807 % 2147483647 + CAST(0.5 AS DOUBLE)) / CAST(2147483647.0 AS DOUBLE))"


def _ellipse_sql(rel: str, keep: str) -> str:
    """(keep, d): distances of the rows (a, b, h, k, x, y) of a relation, by bisection on the foot
    point's parameter."""
    outside = "(long_ * u / (m + long_ * long_)) ** 2 + (short_ * v / (m + short_ * short_)) ** 2 > 1"
    halved = f"lambda acc, e: list_transform([(acc.lo + acc.hi) / 2], lambda m: CASE WHEN {outside} THEN {{'lo': m, 'hi': acc.hi}} ELSE {{'lo': acc.lo, 'hi': m}} END)[1]"
    steps = "list_transform(range(80), lambda i: {'lo': CAST(0 AS DOUBLE), 'hi': CAST(0 AS DOUBLE)})"
    first = "{'lo': short_ * v - short_ * short_, 'hi': sqrt((long_ * u) ** 2 + (short_ * v) ** 2) - short_ * short_}"
    foot = "CASE WHEN v = 0 AND long_ * u < long_ * long_ - short_ * short_ THEN long_ * long_ * u / (long_ * long_ - short_ * short_) WHEN v = 0 THEN long_ ELSE long_ * long_ * u / (t + long_ * long_) END"
    return f"""(SELECT {keep}, sqrt((px - u) ** 2 + (CASE WHEN v = 0 THEN short_ * sqrt(greatest(least(1 - (px / long_) ** 2, 1), 0)) ELSE py END - v) ** 2) AS d FROM (
  SELECT *, least(greatest({foot}, 0), long_) AS px, CASE WHEN v = 0 THEN 0 ELSE short_ * short_ * v / (t + short_ * short_) END AS py FROM (
  SELECT *, (s.lo + s.hi) / 2 AS t FROM (SELECT *, list_reduce({steps}, {halved}, {first}) AS s FROM (
  SELECT *, greatest(a, b) AS long_, least(a, b) AS short_, CASE WHEN a >= b THEN abs(x - h) ELSE abs(y - k) END AS u, CASE WHEN a >= b THEN abs(y - k) ELSE abs(x - h) END AS v FROM {rel})))))"""


# --- sources -------------------------------------------------------------------------------


@_query(f"{with_sql('squares_raw')} SELECT object_id, x0, y0, size, round(radians(theta), 9) AS theta FROM squares_raw")
def read_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with the angle in degrees, read with its schema and radians."""
    from orbitree.sources.objects import read_objects, write_objects

    path = _fresh(spark, "squares")
    write_objects(fixture(spark, sf_dir, "squares_raw"), path, "squares")
    return read_objects(spark, path, "squares").withColumn("theta", F.round("theta", 9))


@_query(f"{with_sql('cuboids')} SELECT object_id, x0, y0, z0, w, h, d, theta, psi, phi FROM cuboids")
def read_cuboids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitree.sources.objects import read_objects, write_objects

    path = _fresh(spark, "cuboids")
    write_objects(fixture(spark, sf_dir, "cuboids"), path, "cuboids")
    return read_objects(spark, path, "cuboids")


@_query(f"{with_sql('ellipses')} SELECT object_id, a, b, h, k FROM ellipses")
def write_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitree.sources.objects import read_objects, write_objects

    path = _fresh(spark, "ellipses")
    write_objects(fixture(spark, sf_dir, "ellipses"), path, "ellipses")
    return read_objects(spark, path, "ellipses")


@_query(f"{with_sql('squares')}, r AS (SELECT object_id, row_number() OVER (ORDER BY object_id) AS rank FROM squares) SELECT object_id, rank, CAST(CASE WHEN rank <= 1000 THEN 1000 WHEN rank <= 5000 THEN 5000 WHEN rank <= 10000 THEN 10000 END AS INTEGER) AS snapshot FROM r WHERE rank <= 5000")
def write_prefix_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitree.sources.objects import read_snapshot
    from orbitree.sources.objects import write_prefix_snapshots as write

    path = _fresh(spark, "snapshots")
    write(fixture(spark, sf_dir, "squares").select("object_id"), path, (1000, 5000, 10000))
    return read_snapshot(spark, path, 5000).select("object_id", "rank", "snapshot")


@_query(f"{with_sql('segments2d')}, r AS (SELECT *, row_number() OVER (ORDER BY object_id) - 1 AS pos FROM segments2d) SELECT pos // 1000 AS part, pos % 1000 AS object_id, x0, y0, length, theta FROM r")
def read_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments as .npy matrices of a thousand rows and back."""
    from orbitree.sources.objects import pack_npy, unpack_npy

    files = materialize(pack_npy(fixture(spark, sf_dir, "segments2d"), "segments2d", 1000), "npy")
    rows = unpack_npy(files, "segments2d")
    return rows.select(F.regexp_extract("file", r"part-([0-9]+)\.npy", 1).cast("long").alias("part"), "object_id", "x0", "y0", "length", "theta")


def _fresh(spark: SparkSession, tag: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/orbitree-{uuid.uuid4().hex}/{tag}"


@_query(f"{with_sql('vertices')} SELECT object_id, CAST(any_value(m) AS BIGINT) AS n, CAST(10 AS BIGINT) AS n_padded, round(sum(x + y), 6) AS total FROM vertices GROUP BY object_id")
def polygons_pad_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded to ten vertices and stripped again."""
    padded = fixture(spark, sf_dir, "polygons").withColumn("padded", g.polygons_pad(c("vertices"), F.lit(10)))
    back = padded.withColumn("vertices", g.polygons_unpad(c("padded")))
    total = F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["x"] + v["y"])
    return back.select("object_id", F.size("vertices").cast("long").alias("n"), F.size("padded").cast("long").alias("n_padded"), _r(total).alias("total"))


# --- scalar geometry -----------------------------------------------------------------------


@_query(f"{with_sql('squares_raw')} SELECT object_id, round(radians(theta), 9) AS theta FROM squares_raw")
def deg2rad_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.deg2rad_last(fixture(spark, sf_dir, "squares_raw"), "theta").select("object_id", F.round("theta", 9).alias("theta"))


@_query(f"""{with_sql('squares')}, b AS (SELECT min(x0) - max(size) AS lx, max(x0) + max(size) AS hx, min(y0) - max(size) AS ly, max(y0) + max(size) AS hy FROM squares)
SELECT object_id, round((x0 - lx) / (hx - lx), 9) AS x0, round((y0 - ly) / (hy - ly), 9) AS y0, round(size / greatest(hx - lx, hy - ly), 9) AS size FROM squares, b""")
def normalize_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.normalize_squares(fixture(spark, sf_dir, "squares")).select("object_id", *(F.round(x, 9).alias(x) for x in ("x0", "y0", "size")))


def _norm3(x: str, s: str) -> str:
    lo, hi = f"(min({x}) OVER () - max({s}) OVER ())", f"(max({x}) OVER () + max({s}) OVER ())"
    return f"round(({x} - {lo}) / ({hi} - {lo}), 9) AS {x}, round({s} / ({hi} - {lo}), 9) AS {s}"


@_query(f"{with_sql('cuboids')} SELECT object_id, {_norm3('x0', 'w')}, {_norm3('y0', 'h')}, {_norm3('z0', 'd')} FROM cuboids")
def normalize_cuboids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.normalize_cuboids(fixture(spark, sf_dir, "cuboids")).select("object_id", *(F.round(x, 9).alias(x) for x in ("x0", "w", "y0", "h", "z0", "d")))


@_query(f"""{with_sql('ellipses')}, b AS (SELECT min(h) AS lh, max(h) AS uh, min(k) AS lk, max(k) AS uk, max(a) AS ma, max(b) AS mb FROM ellipses)
SELECT object_id, round(a / (uh - lh), 9) AS a, round(e.b / (uk - lk), 9) AS b, round((h - lh + ma) / (uh - lh + 2 * ma), 9) AS h, round((k - lk + mb) / (uk - lk + 2 * mb), 9) AS k FROM ellipses e, b""")
def normalize_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.normalize_ellipses(fixture(spark, sf_dir, "ellipses")).select("object_id", *(F.round(x, 9).alias(x) for x in ("a", "b", "h", "k")))


@_query(f"{with_sql('vertices')}, n AS (SELECT sqrt(sum((x * 1e-5) ** 2 + (y * 1e-5) ** 2)) AS norm FROM vertices) SELECT object_id, round(sum(x * 1e-5 / norm), 9) AS sx, round(sum(y * 1e-5 / norm), 9) AS sy FROM vertices, n GROUP BY object_id")
def normalize_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.normalize_polygons(fixture(spark, sf_dir, "polygons"))
    total = lambda a: F.round(F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v[a]), 9)
    return rows.select("object_id", total("x").alias("sx"), total("y").alias("sy"))


def _flat(df: DataFrame, vertices: Column, n: int, axes: str = "xy") -> DataFrame:
    v = df.select("object_id", vertices.alias("v"))
    return v.select("object_id", *(_r(F.get("v", F.lit(i))[a]).alias(f"{a}{i}") for i in range(n) for a in axes))


@_query(f"{with_sql('squares')} SELECT object_id, {', '.join(f'round({x}, 6) AS x{i}, round({y}, 6) AS y{i}' for i, (x, y) in enumerate(_CORNERS))} FROM squares")
def square_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fixture(spark, sf_dir, "squares"), g.square_vertices(c("x0"), c("y0"), c("size"), c("theta")), 4)


@_query(f"{with_sql('squares')} SELECT object_id, {', '.join(f'round(x0 + {sx} * size / 2, 6) AS x{i}, round(y0 + {sy} * size / 2, 6) AS y{i}' for i, (sx, sy) in enumerate(((-1, -1), (-1, 1), (1, 1), (1, -1))))} FROM squares")
def square_vertices_unrotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fixture(spark, sf_dir, "squares"), g.square_vertices_unrotated(c("x0"), c("y0"), c("size")), 4)


_SIGNS = [(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]


@_query(f"{with_sql('cuboids')} SELECT object_id, {', '.join(f'round(x0 + {a} * w / 2, 6) AS x{i}, round(y0 + {b} * h / 2, 6) AS y{i}, round(z0 + {e} * d / 2, 6) AS z{i}' for i, (a, b, e) in enumerate(_SIGNS))} FROM cuboids")
def cuboid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fixture(spark, sf_dir, "cuboids"), g.cuboid_vertices(*(c(x) for x in ("x0", "y0", "z0", "w", "h", "d"))), 8, "xyz")


@_query(_pair_sql("squares_raw", "point_id, round(x0 + (x - x0) * cos(radians(theta)) - (y - y0) * sin(radians(theta)), 6) AS rx, round(y0 + (x - x0) * sin(radians(theta)) + (y - y0) * cos(radians(theta)), 6) AS ry"))
def rotate_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, "squares_raw").withColumn("v", g.rotate_point(c("x"), c("y"), c("x0"), c("y0"), c("theta")))
    return rows.select("object_id", "point_id", _r(c("v.x")).alias("rx"), _r(c("v.y")).alias("ry"))


@_query(_pair_sql("segments3d", "point_id, round(x0 + (x - x0) * cos(theta) - (y - y0) * sin(theta), 6) AS rx, round(y0 + (x - x0) * sin(theta) + (y - y0) * cos(theta), 6) AS ry, round(z - z0, 6) AS rz", "unit_points"))
def rotate_point3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, "segments3d", "unit_points").withColumn("v", g.rotate_point3(*(c(x) for x in ("x", "y", "z", "x0", "y0", "z0", "theta"))))
    return rows.select("object_id", "point_id", *(_r(c(f"v.{a}")).alias(f"r{a}") for a in "xyz"))


@_query(f"{with_sql('segments2d')} SELECT object_id, round(x0 + length * cos(theta), 6) AS x1, round(y0 + length * sin(theta), 6) AS y1 FROM segments2d")
def segment_endpoints_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "segments2d").withColumn("v", g.segment_end_2d(c("x0"), c("y0"), c("length"), c("theta")))
    return rows.select("object_id", _r(c("v.x")).alias("x1"), _r(c("v.y")).alias("y1"))


@_query(f"{with_sql('segments3d')} SELECT object_id, round(x0 + {_D3[0]}, 6) AS x1, round(y0 + {_D3[1]}, 6) AS y1, round(z0 + {_D3[2]}, 6) AS z1 FROM segments3d")
def segment_endpoints_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "segments3d").withColumn("v", g.segment_end_3d(*(c(x) for x in ("x0", "y0", "z0", "length", "theta", "phi"))))
    return rows.select("object_id", *(_r(c(f"v.{a}")).alias(f"{a}1") for a in "xyz"))


@_query(f"{with_sql('ellipses')} SELECT object_id, round(a, 6) AS a, round(b, 6) AS b, round(h, 6) AS h, round(k, 6) AS k FROM ellipses")
def box_to_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses through their boxes and back."""
    rows = fixture(spark, sf_dir, "ellipses").withColumn("box", g.ellipse_box(c("a"), c("b"), c("h"), c("k")))
    rows = rows.withColumn("e", g.box_to_ellipse(c("box.x_min"), c("box.x_max"), c("box.y_min"), c("box.y_max")))
    return rows.select("object_id", *(_r(c(f"e.{x}")).alias(x) for x in "abhk"))


@_query(
    f"""{with_sql('squares', 'cuboids', 'ellipses', 'segments2d', 'segments3d', 'vertices')}
SELECT 'squares' AS kind, object_id, round(x0, 6) AS x, round(y0, 6) AS y FROM squares
UNION ALL SELECT 'cuboids', object_id, round(x0, 6), round(y0, 6) FROM cuboids
UNION ALL SELECT 'ellipses', object_id, round(h, 6), round(k, 6) FROM ellipses
UNION ALL SELECT 'segments2d', object_id, round(x0 + length * cos(theta) / 2, 6), round(y0 + length * sin(theta) / 2, 6) FROM segments2d
UNION ALL SELECT 'segments3d', object_id, round(x0 + {_D3[0]} / 2, 6), round(y0 + {_D3[1]} / 2, 6) FROM segments3d
UNION ALL SELECT 'polygons', object_id, round(avg(x), 6), round(avg(y), 6) FROM vertices GROUP BY object_id"""
)
def representative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, metric in m.METRICS.items():
        centre = metric.centre(metric.of())
        rows = fixture(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), "object_id", _r(centre[0]).alias("x"), _r(centre[1]).alias("y"))
        out = rows if out is None else out.union(rows)
    return out


_REACH = "size / 2 * (abs(cos(theta)) + abs(sin(theta)))"


@_query(
    f"""{with_sql('squares', 'ellipses', 'segments2d', 'vertices')}
SELECT 'squares' AS kind, object_id, round(x0 - {_REACH}, 6) AS x_lo, round(x0 + {_REACH}, 6) AS x_hi, round(y0 - {_REACH}, 6) AS y_lo, round(y0 + {_REACH}, 6) AS y_hi FROM squares
UNION ALL SELECT 'ellipses', object_id, round(h - a, 6), round(h + a, 6), round(k - b, 6), round(k + b, 6) FROM ellipses
UNION ALL SELECT 'segments2d', object_id, round(least(x0, x0 + length * cos(theta)), 6), round(greatest(x0, x0 + length * cos(theta)), 6), round(least(y0, y0 + length * sin(theta)), 6), round(greatest(y0, y0 + length * sin(theta)), 6) FROM segments2d
UNION ALL SELECT 'polygons', object_id, round(min(x), 6), round(max(x), 6), round(min(y), 6), round(max(y), 6) FROM vertices GROUP BY object_id"""
)
def object_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("squares", "ellipses", "segments2d", "polygons"):
        (x_lo, x_hi), (y_lo, y_hi) = m.METRICS[kind].box(m.METRICS[kind].of())
        rows = fixture(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), "object_id", _r(x_lo).alias("x_lo"), _r(x_hi).alias("x_hi"), _r(y_lo).alias("y_lo"), _r(y_hi).alias("y_hi"))
        out = rows if out is None else out.union(rows)
    return out


_DIGITS = "CAST(c_custkey % 3 AS VARCHAR) || CAST((c_custkey // 3) % 3 AS VARCHAR) || CAST((c_custkey // 9) % 3 AS VARCHAR)"


@_query(f"SELECT c_custkey AS object_id, {_DIGITS} AS path, CAST(27 + 9 * (c_custkey % 3) + 3 * ((c_custkey // 3) % 3) + (c_custkey // 9) % 3 AS BIGINT) AS number FROM customer")
def path_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_custkey").alias("object_id"), F.concat(*(F.expr(f"cast((c_custkey div {d}) % 3 AS string)") for d in (1, 3, 9))).alias("path"))
    return rows.withColumn("number", g.path_to_int(c("path"), 3))


# --- predicates ----------------------------------------------------------------------------


@_query(
    f"""{with_sql('points2d', 'vertices')}, {_ids_sql('vertices', 'points2d')}, {_EDGES},
pairs AS (SELECT point_id, object_id, ox + (x - 150) / 75 AS x, oy + (y - 150) / 75 AS y FROM ids JOIN points2d USING (point_id) JOIN (SELECT object_id, avg(x) AS ox, avg(y) AS oy FROM vertices GROUP BY object_id) o USING (object_id)),
hits AS (SELECT point_id, object_id, count(*) FILTER (WHERE y > least(ay, ey) AND y <= greatest(ay, ey) AND x <= greatest(ax, ex) AND (ax = ex OR x <= ax + (y - ay) * (ex - ax) / (ey - ay))) AS k FROM pairs JOIN edges USING (object_id) GROUP BY point_id, object_id)
SELECT object_id, point_id, k % 2 = 1 AS inside FROM hits"""
)
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point moved close to its polygon."""
    return _beside_polygon(_pairs(spark, sf_dir, "polygons"))


def _beside_polygon(rows: DataFrame) -> DataFrame:
    """Points moved close to their polygons. The mean's last bit, and with it a point on an edge, depends on the order of
    the sum: SQL's aggregate meets the vertices from the last to the first."""
    rows = rows.withColumn("mid", g.vertex_mean(F.reverse("vertices")))
    x, y = c("mid.x") + (c("x") - 150) / 75, c("mid.y") + (c("y") - 150) / 75
    return rows.select("object_id", "point_id", p.point_in_polygon(x, y, c("vertices")).alias("inside"))


_NEIGHBOURS = "SELECT a.*, b.x0 AS bx0, b.y0 AS by0, b.size AS bsize, b.theta AS btheta FROM squares a JOIN squares b ON b.object_id = a.object_id + 1"


def _next_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every square with the next one, moved next to it so that both outcomes occur."""
    a = fixture(spark, sf_dir, "squares")
    b = a.select((c("object_id") - 1).alias("object_id"), c("x0").alias("u0"), c("y0").alias("v0"), c("size").alias("bsize"), c("theta").alias("btheta"))
    return a.join(b, "object_id").withColumn("bx0", c("x0") + (c("u0") - c("x0")) / 60).withColumn("by0", c("y0") + (c("v0") - c("y0")) / 60)


_NEXT = f"{with_sql('squares')}, q AS (SELECT a.object_id, a.x0, a.y0, a.size, a.theta, a.x0 + (b.x0 - a.x0) / 60 AS bx0, a.y0 + (b.y0 - a.y0) / 60 AS by0, b.size AS bsize, b.theta AS btheta FROM squares a JOIN squares b ON b.object_id = a.object_id + 1)"
_B_CORNERS = [_corner(i, "bx0", "by0", "bsize", "btheta") for i in range(4)]
_VERTEX_HIT = " OR ".join([_inside_sql(x, y, _B_CORNERS) for x, y in _CORNERS] + [_inside_sql(x, y, _CORNERS) for x, y in _B_CORNERS])


def _cross_sql(a: tuple[str, str], b: tuple[str, str], e: tuple[str, str], f: tuple[str, str]) -> str:
    rx, ry, sx, sy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})", f"({f[0]} - {e[0]})", f"({f[1]} - {e[1]})"
    den, qx, qy = f"NULLIF({rx} * {sy} - {ry} * {sx}, 0)", f"({e[0]} - {a[0]})", f"({e[1]} - {a[1]})"
    return f"COALESCE(({qx} * {sy} - {qy} * {sx}) / {den} BETWEEN 0 AND 1 AND ({qx} * {ry} - {qy} * {rx}) / {den} BETWEEN 0 AND 1, false)"


@_query(f"{_NEXT} SELECT object_id, abs(x0 - bx0) <= (size + bsize) / 2 AND abs(y0 - by0) <= (size + bsize) / 2 AS hit FROM q")
def aabb_overlap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_squares(spark, sf_dir).select("object_id", p.aabb_overlap_2d(*(c(x) for x in ("x0", "y0", "size", "bx0", "by0", "bsize"))).alias("hit"))


@_query(f"{_NEXT} SELECT object_id, x0 < bx0 + bsize AND bx0 < x0 + size AND y0 < by0 + bsize AND by0 < y0 + size AS hit FROM q")
def corner_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_squares(spark, sf_dir).select("object_id", p.corner_box_overlap(*(c(x) for x in ("x0", "y0", "size", "bx0", "by0", "bsize"))).alias("hit"))


@_query(f"{_NEXT} SELECT object_id, {_VERTEX_HIT} AS hit FROM q")
def squares_vertex_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(_next_squares(spark, sf_dir)).select("object_id", p.vertex_intersect(c("ring_a"), c("ring_b")).alias("hit"))


@_query(f"{_NEXT} SELECT object_id, {' OR '.join(_cross_sql(_CORNERS[i], _CORNERS[(i + 1) % 4], _B_CORNERS[j], _B_CORNERS[(j + 1) % 4]) for i in range(4) for j in range(4))} OR {_VERTEX_HIT} AS hit FROM q")
def squares_edge_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(_next_squares(spark, sf_dir)).select("object_id", p.edge_intersect(c("ring_a"), c("ring_b")).alias("hit"))


def _rings(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ring_a", g.square_vertices(c("x0"), c("y0"), c("size"), c("theta"))).withColumn("ring_b", g.square_vertices(c("bx0"), c("by0"), c("bsize"), c("btheta")))


_CUBE_NEXT = f"{with_sql('cuboids')}, q AS (SELECT a.*, a.x0 + (b.x0 - a.x0) / 60 AS mx, a.y0 + (b.y0 - a.y0) / 60 AS my, a.z0 + (b.z0 - a.z0) / 60 AS mz, b.w AS bw, b.h AS bh, b.d AS bd FROM cuboids a JOIN cuboids b ON b.object_id = a.object_id + 1)"


def _next_cuboids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "cuboids")
    b = a.select((c("object_id") - 1).alias("object_id"), *(c(x).alias(f"n{x}") for x in ("x0", "y0", "z0")), *(c(x).alias(f"b{x}") for x in ("w", "h", "d")))
    rows = a.join(b, "object_id")
    for axis in "xyz":
        rows = rows.withColumn(f"b{axis}", c(f"{axis}0") + (c(f"n{axis}0") - c(f"{axis}0")) / 60)
    return rows


@_query(f"{_CUBE_NEXT} SELECT object_id, abs(x0 - mx) <= (w + bw) / 2 AND abs(y0 - my) <= (h + bh) / 2 AND abs(z0 - mz) <= (d + bd) / 2 AS hit FROM q")
def aabb_overlap_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = p.aabb_overlap_3d(tuple(c(x) for x in ("x0", "y0", "z0", "w", "h", "d")), tuple(c(x) for x in ("bx", "by", "bz", "bw", "bh", "bd")))
    return _next_cuboids(spark, sf_dir).select("object_id", hit.alias("hit"))


def _bend_sql(p_: str, q_: str, r_: str) -> str:
    return f"sign(({q_}y - {p_}y) * ({r_}x - {q_}x) - ({q_}x - {p_}x) * ({r_}y - {q_}y))"


def _within_sql(p_: str, q_: str, r_: str) -> str:
    return f"({q_}x BETWEEN least({p_}x, {r_}x) AND greatest({p_}x, {r_}x) AND {q_}y BETWEEN least({p_}y, {r_}y) AND greatest({p_}y, {r_}y))"


_BENDS = [_bend_sql("a.p", "a.q", "b.p"), _bend_sql("a.p", "a.q", "b.q"), _bend_sql("b.p", "b.q", "a.p"), _bend_sql("b.p", "b.q", "a.q")]
_SHADOW = f"({_BENDS[0]} <> {_BENDS[1]} AND {_BENDS[2]} <> {_BENDS[3]}) OR ({_BENDS[0]} = 0 AND {_within_sql('a.p', 'b.p', 'a.q')}) OR ({_BENDS[1]} = 0 AND {_within_sql('a.p', 'b.q', 'a.q')}) OR ({_BENDS[2]} = 0 AND {_within_sql('b.p', 'a.p', 'b.q')}) OR ({_BENDS[3]} = 0 AND {_within_sql('b.p', 'a.q', 'b.q')})"


@_query(
    f"""{_CUBE_NEXT}, s AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b, _) in enumerate(_SIGNS))}) AS s(i, sx, sy)),
va AS (SELECT object_id, i, x0 + sx * w / 2 AS x, y0 + sy * h / 2 AS y FROM q, s), vb AS (SELECT object_id, i, mx + sx * bw / 2 AS x, my + sy * bh / 2 AS y FROM q, s),
la AS (SELECT f.object_id, f.x AS px, f.y AS py, g.x AS qx, g.y AS qy FROM va f JOIN va g ON f.object_id = g.object_id AND f.i < g.i), lb AS (SELECT f.object_id, f.x AS px, f.y AS py, g.x AS qx, g.y AS qy FROM vb f JOIN vb g ON f.object_id = g.object_id AND f.i < g.i)
SELECT a.object_id, bool_or({_SHADOW}) AS hit FROM la a JOIN lb b ON a.object_id = b.object_id GROUP BY a.object_id"""
)
def cuboids_edge_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _next_cuboids(spark, sf_dir)
    rows = rows.withColumn("va", g.cuboid_vertices(*(c(x) for x in ("x0", "y0", "z0", "w", "h", "d")))).withColumn("vb", g.cuboid_vertices(*(c(x) for x in ("bx", "by", "bz", "bw", "bh", "bd"))))
    return rows.select("object_id", p.cuboids_edge_intersect(c("va"), c("vb")).alias("hit"))


_SEG_NEXT = f"""{with_sql('segments2d')}, q AS (SELECT a.object_id, a.x0 AS ax, a.y0 AS ay, a.x0 + a.length * cos(a.theta) AS cx, a.y0 + a.length * sin(a.theta) AS cy,
 a.x0 + (b.x0 - a.x0) / 200 AS ex, a.y0 + (b.y0 - a.y0) / 200 AS ey, a.x0 + (b.x0 - a.x0) / 200 - b.length * cos(b.theta) AS fx, a.y0 + (b.y0 - a.y0) / 200 - b.length * sin(b.theta) AS fy FROM segments2d a JOIN segments2d b ON b.object_id = a.object_id + 1)"""


def _next_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "segments2d")
    b = a.select((c("object_id") - 1).alias("object_id"), c("x0").alias("nx"), c("y0").alias("ny"), c("length").alias("nl"), c("theta").alias("nt"))
    rows = a.join(b, "object_id").withColumn("ex", c("x0") + (c("nx") - c("x0")) / 200).withColumn("ey", c("y0") + (c("ny") - c("y0")) / 200)
    ends = [(c("x0"), c("y0")), (c("x0") + c("length") * F.cos("theta"), c("y0") + c("length") * F.sin("theta")), (c("ex"), c("ey")), (c("ex") - c("nl") * F.cos("nt"), c("ey") - c("nl") * F.sin("nt"))]
    return rows.select("object_id", *(g.point(x, y).alias(f"p{i}") for i, (x, y) in enumerate(ends)))


@_query(f"{_SEG_NEXT} SELECT object_id, {_cross_sql(('ax', 'ay'), ('cx', 'cy'), ('ex', 'ey'), ('fx', 'fy'))} AS hit FROM q")
def segments_intersect_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_segments(spark, sf_dir).select("object_id", p.segments_intersect_param(c("p0"), c("p1"), c("p2"), c("p3")).alias("hit"))


def _turn_sql(a: str, b: str, d: str) -> str:
    return f"sign(({b}y - {a}y) * ({d}x - {b}x) - ({b}x - {a}x) * ({d}y - {b}y))"


@_query(f"{_SEG_NEXT} SELECT object_id, ({_turn_sql('a', 'c', 'e')} <> {_turn_sql('a', 'c', 'f')} AND {_turn_sql('e', 'f', 'a')} <> {_turn_sql('e', 'f', 'c')}) AS hit FROM q")
def segments_intersect_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_segments(spark, sf_dir).select("object_id", p.segments_intersect_orient(c("p0"), c("p1"), c("p2"), c("p3")).alias("hit"))


_NEAR_ELLIPSE = "h + (x - 150) / 100 AS nx, k + (y - 150) / 100 AS ny"


@_query(_pair_sql("ellipses", "point_id, nx > h - a / 2 AND nx < h + a / 2 AND ny > k - b / 2 AND ny < k + b / 2 AS inside", extra=f", near AS (SELECT *, {_NEAR_ELLIPSE} FROM pairs)").replace("FROM pairs", "FROM near").replace("FROM near)", "FROM pairs)"))
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, "ellipses").withColumn("b_", g.ellipse_box(c("a"), c("b"), c("h"), c("k")))
    return rows.select("object_id", "point_id", p.point_in_box(c("h") + (c("x") - 150) / 100, c("k") + (c("y") - 150) / 100, c("b_.x_min"), c("b_.x_max"), c("b_.y_min"), c("b_.y_max")).alias("inside"))


# --- metrics -------------------------------------------------------------------------------


@_query("""WITH e AS (SELECT a.vec_id, a.embedding AS u, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_max(list_transform(range(1, len(u) + 1), lambda i: abs(CAST(u[i] AS DOUBLE) - CAST(v[i] AS DOUBLE)))), 6) AS dist FROM e""")
def linf_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "vectors")
    b = a.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("v"))
    return a.join(b, "vec_id").select("vec_id", _r(m.linf_point(c("embedding"), c("v"))).alias("dist"))


@_query(_pair_sql("squares", "point_id, round(sqrt((x - x0) ** 2 + (y - y0) ** 2), 6) AS dist"))
def euclid_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "squares").select("object_id", "point_id", _r(m.euclid_point(c("x"), c("y"), c("x0"), c("y0"))).alias("dist"))


@_query(_pair_sql("squares", f"point_id, round({_CORNER_DIST}, 6) AS dist"))
def linf_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "squares").select("object_id", "point_id", _r(m.linf_vertices(g.square_vertices(c("x0"), c("y0"), c("size"), c("theta")), c("x"), c("y"))).alias("dist"))


@_query(_pair_sql("squares", f"point_id, round({_LINF_SQUARE}, 6) AS dist"))
def linf_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "squares").select("object_id", "point_id", _r(m.linf_square(*(c(x) for x in ("x0", "y0", "size", "theta", "x", "y")))).alias("dist"))


def _edge_linf(a: tuple[str, str], b: tuple[str, str]) -> str:
    ax, ay, dx, dy = f"({a[0]} - x)", f"({a[1]} - y)", f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    tries = []
    for t in ("0", f"COALESCE(({ay} - {ax}) / NULLIF({dx} - {dy}, 0), 0)", f"COALESCE((-{ay} - {ax}) / NULLIF({dx} + {dy}, 0), 0)"):
        t = f"least(greatest({t}, 0), 1)"
        tries.append(f"greatest(abs({ax} + {t} * {dx}), abs({ay} + {t} * {dy}))")
    return ", ".join(tries)


@_query(_pair_sql("squares", f"point_id, round(least({', '.join(_edge_linf(_CORNERS[i], _CORNERS[(i + 1) % 4]) for i in range(4))}), 6) AS dist"))
def linf_square_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "squares").select("object_id", "point_id", _r(m.linf_square_exact(*(c(x) for x in ("x0", "y0", "size", "theta", "x", "y")))).alias("dist"))


@_query(_pair_sql("cuboids", f"point_id, round({_LINF_CUBOID}, 9) AS dist, round(greatest(abs(x0 - x) - w / 2, abs(y0 - y) - h / 2, abs(z0 - z) - d / 2, 0), 9) AS exact", "points3d"))
def linf_cuboid(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = [c(x) for x in ("x0", "y0", "z0", "w", "h", "d", "x", "y", "z")]
    return _pairs(spark, sf_dir, "cuboids", "points3d").select("object_id", "point_id", _r(m.linf_cuboid(*args), 9).alias("dist"), _r(m.linf_cuboid_exact(*args), 9).alias("exact"))


@_query(f"{with_sql('points2d', 'ellipses')}, {_ids_sql('ellipses', 'points2d')}, pairs AS (SELECT * FROM ids JOIN points2d USING (point_id) JOIN ellipses USING (object_id)) SELECT point_id, object_id, round(d, 6) AS dist FROM {_ellipse_sql('pairs', 'point_id, object_id')}")
def ellipse_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "ellipses").select("point_id", "object_id", _r(m.ellipse_dist(*(c(x) for x in ("a", "b", "h", "k", "x", "y")))).alias("dist"))


@_query(_pair_sql("segments2d", f"point_id, round({_SEG2}, 6) AS dist", "unit_points"))
def segment_dist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "segments2d", "unit_points").select("object_id", "point_id", _r(m.segment_dist_2d(*(c(x) for x in ("x0", "y0", "length", "theta", "x", "y")))).alias("dist"))


@_query(_pair_sql("segments3d", f"point_id, round({_SEG3}, 6) AS dist", "unit_points"))
def segment_dist_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "segments3d", "unit_points").select("object_id", "point_id", _r(m.segment_dist_3d(*(c(x) for x in ("x0", "y0", "z0", "length", "theta", "phi", "x", "y", "z")))).alias("dist"))


@_query(f"{with_sql('points2d', 'vertices')}, {_ids_sql('vertices', 'points2d')}, {_EDGES} SELECT object_id, point_id, round({_edge_sql('x', 'y', 'ax', 'ay', 'ex', 'ey')}, 6) AS dist FROM ids JOIN points2d USING (point_id) JOIN edges USING (object_id) WHERE i = 0")
def edge_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.get("vertices", F.lit(0)), F.get("vertices", F.lit(1))
    return _pairs(spark, sf_dir, "polygons").select("object_id", "point_id", _r(m.edge_dist(c("x"), c("y"), a["x"], a["y"], b["x"], b["y"])).alias("dist"))


@_query(f"{with_sql('points2d', 'vertices')}, {_ids_sql('vertices', 'points2d')}, {_EDGES} SELECT object_id, point_id, round(min({_edge_sql('x', 'y', 'ax', 'ay', 'ex', 'ey')}), 6) AS dist FROM ids JOIN points2d USING (point_id) JOIN edges USING (object_id) GROUP BY point_id, object_id")
def polygon_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "polygons").select("object_id", "point_id", _r(m.polygon_dist(c("vertices"), c("x"), c("y"))).alias("dist"))


def _axis_sql(lo: str, hi: str, q: str) -> str:
    return f"CASE WHEN {lo} < {q} AND {q} < {hi} THEN CAST(-1 AS DOUBLE) ELSE least(abs({q} - ({lo})), abs({q} - ({hi}))) END"


@_query(_pair_sql("ellipses", f"point_id, round(greatest({_axis_sql('h - a / 2', 'h + a / 2', 'x')}, {_axis_sql('k - b / 2', 'k + b / 2', 'y')}), 6) AS dist"))
def box_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, "ellipses").withColumn("b_", g.ellipse_box(c("a"), c("b"), c("h"), c("k")))
    return rows.select("object_id", "point_id", _r(m.box_dist(c("b_.x_min"), c("b_.x_max"), c("b_.y_min"), c("b_.y_max"), c("x"), c("y"))).alias("dist"))


def _centre_metric() -> m.Metric:
    """A user's metric with bounds: Chebyshev distance to a square's centre."""
    mid = lambda o: [o["x0"], o["y0"]]
    return m.Metric("centres", ("x0", "y0"), 2, lambda o, q: F.greatest(F.abs(o["x0"] - q[0]), F.abs(o["y0"] - q[1])), lambda o: [(o["x0"], o["x0"]), (o["y0"], o["y0"])], mid, mid)


_CENTRES = f"{with_sql('squares', 'points2d')} SELECT point_id, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM (SELECT point_id, object_id, greatest(abs(x0 - x), abs(y0 - y)) AS d FROM points2d, squares) GROUP BY point_id"


@_query(_CENTRES)
def user_metric_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "squares"), fixture(spark, sf_dir, "points2d"), _centre_metric())
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(_CENTRES)
def user_kernel_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metric as a kernel only: no bounds, so blocks are compared."""
    kernel = lambda o, q: np.maximum(np.abs(o["x0"][:, None] - q[None, :, 0]), np.abs(o["y0"][:, None] - q[None, :, 1]))
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "squares"), fixture(spark, sf_dir, "points2d"), m.Metric("centres", ("x0", "y0"), 2, kernel=kernel))
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query("""WITH p AS (SELECT vec_id AS point_id, embedding AS u FROM embeddings), o AS (SELECT vec_id AS object_id, embedding AS v FROM embeddings),
d AS (SELECT point_id, object_id, list_max(list_transform(list_zip(u, v), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d FROM p, o WHERE point_id <> object_id),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), object_id) AS rank FROM d)
SELECT point_id, rank, object_id, round(d, 6) AS dist FROM r WHERE rank <= 3""")
def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other vectors in 64 dimensions, by a kernel."""
    vectors = fixture(spark, sf_dir, "vectors")
    metric = m.vector_metric("embedding", 64)
    points = vectors.select(c("vec_id").alias("point_id"), F.transform("embedding", lambda v: v.cast("double")).alias("p"))
    near = neighbors.knn(vectors.select(c("vec_id").alias("object_id"), "embedding"), points, metric, 4)
    # a vector is its own nearest, unless copies with smaller ids come first
    other = near.where("point_id <> object_id").drop("rank")
    order = Window.partitionBy("point_id").orderBy(F.round("dist", 9), "object_id")
    ranked = other.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")
    return ranked.select("point_id", "rank", "object_id", _r(c("dist")).alias("dist"))


# --- joins ---------------------------------------------------------------------------------

_SEEDS = [[75.0, 75.0], [225.0, 75.0], [150.0, 225.0]]


@_query(f"{with_sql('squares')}, s AS (SELECT * FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y)) SELECT object_id, CAST(i AS BIGINT) AS c_idx, round({_LINF_SQUARE}, 6) AS dist FROM squares, (SELECT i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM s)")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.distance_matrix(fixture(spark, sf_dir, "squares"), _SEEDS, m.METRICS["squares"]).select("object_id", "c_idx", _r(c("dist")).alias("dist"))


_ALL_SQUARES = f"{with_sql('squares', 'points2d')}, v AS (SELECT *, {', '.join(f'{cx} AS cx{i}, {cy} AS cy{i}' for i, (cx, cy) in enumerate(_CORNERS))} FROM squares)"
_VC = [(f"cx{i}", f"cy{i}") for i in range(4)]
_LINF_V = f"CASE WHEN {_inside_sql('x', 'y', _VC)} THEN CAST(0 AS DOUBLE) ELSE least({', '.join(f'greatest(abs({a} - x), abs({b} - y))' for a, b in _VC)}) END"


@_query(f"{_ALL_SQUARES} SELECT point_id, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM (SELECT point_id, object_id, {_LINF_V} AS d FROM points2d, v) GROUP BY point_id")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "squares"), fixture(spark, sf_dir, "points2d"), m.METRICS["squares"])
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(f"{_ALL_SQUARES}, d AS (SELECT point_id, min({{'r': round(d, 9), 'o': object_id, 'd': d}}, 3) AS b FROM (SELECT point_id, object_id, {_LINF_V} AS d FROM points2d, v) GROUP BY point_id), u AS (SELECT point_id, unnest(b) AS b, generate_subscripts(b, 1) AS rank FROM d) SELECT point_id, CAST(rank AS BIGINT) AS rank, b.o AS object_id, round(b.d, 6) AS dist FROM u")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.knn(fixture(spark, sf_dir, "squares"), fixture(spark, sf_dir, "points2d"), m.METRICS["squares"], 3)
    return near.select("point_id", "rank", "object_id", _r(c("dist")).alias("dist"))


def _nearest_sql(tables: tuple[str, ...], objects: str, points: str, dist: str, digits: int = 6, k: int = 1) -> str:
    """The k nearest by two passes: the k-th distance of each point, then what is as near. ``objects``
    is a query; an object can have several rows, of which the nearest counts."""
    rows = f"(SELECT point_id, object_id, {dist} AS d FROM p_, o_)"
    return f"""{with_sql(*tables)}, o_ AS MATERIALIZED ({objects}), p_ AS MATERIALIZED (SELECT * FROM {points}), b_ AS MATERIALIZED (SELECT point_id, list_max(min(d, {k})) + 0.00000001 AS most FROM {rows} GROUP BY point_id),
near AS (SELECT point_id, object_id, min(d) AS d FROM {rows} JOIN b_ USING (point_id) WHERE d <= most GROUP BY point_id, object_id),
r_ AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), object_id) AS rank FROM near) SELECT point_id, {'rank, ' if k > 1 else ''}object_id, round(d, {digits}) AS dist FROM r_ WHERE rank <= {k}"""


_SEGMENT_ENDS = "SELECT object_id, x0, y0, x0 + length * cos(theta) AS ex, y0 + length * sin(theta) AS ey FROM segments2d"
_SEGMENT_SPANS = f"SELECT object_id, x0, y0, z0, {_D3[0]} AS dx, {_D3[1]} AS dy, {_D3[2]} AS dz FROM segments3d"
_SPAN_T = "least(greatest(COALESCE(((x - x0) * dx + (y - y0) * dy + (z - z0) * dz) / NULLIF(dx ** 2 + dy ** 2 + dz ** 2, 0), 0), 0), 1)"
_SPAN_DIST = f"sqrt((x - x0 - {_SPAN_T} * dx) ** 2 + (y - y0 - {_SPAN_T} * dy) ** 2 + (z - z0 - {_SPAN_T} * dz) ** 2)"


@_query(_nearest_sql(("segments2d", "unit_points"), _SEGMENT_ENDS, "unit_points", _edge_sql("x", "y", "x0", "y0", "ex", "ey"), 6, 3))
def knn_segments2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.knn(fixture(spark, sf_dir, "segments2d"), fixture(spark, sf_dir, "unit_points"), m.METRICS["segments2d"], 3)
    return near.select("point_id", "rank", "object_id", _r(c("dist")).alias("dist"))


@_query(_nearest_sql(("segments3d", "unit_points"), _SEGMENT_SPANS, "unit_points", _SPAN_DIST))
def nearest_segment3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "segments3d"), fixture(spark, sf_dir, "unit_points"), m.METRICS["segments3d"])
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(_nearest_sql(("cuboids", "points3d"), "SELECT * FROM cuboids", "points3d", _LINF_CUBOID))
def nearest_cuboid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "cuboids"), fixture(spark, sf_dir, "points3d"), m.METRICS["cuboids"])
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(
    f"""{with_sql('ellipses', 'points2d')}, e_ AS MATERIALIZED (SELECT * FROM ellipses), p_ AS MATERIALIZED (SELECT * FROM points2d),
most AS (SELECT point_id, min(sqrt((h + a - x) ** 2 + (k - y) ** 2)) + 0.00000001 AS most FROM p_, e_ GROUP BY point_id),
near AS MATERIALIZED (SELECT point_id, object_id, a, b, h, k, x, y FROM p_ JOIN most USING (point_id), e_ WHERE greatest(abs(x - h) - a, abs(y - k) - b) <= most)
SELECT point_id, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM {_ellipse_sql('near', 'point_id, object_id')} GROUP BY point_id"""
)
def nearest_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "ellipses"), fixture(spark, sf_dir, "points2d"), m.METRICS["ellipses"])
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(_nearest_sql(("vertices", "points2d"), f"WITH {_EDGES} SELECT object_id, ax, ay, ex, ey FROM edges", "points2d", _edge_sql("x", "y", "ax", "ay", "ex", "ey")))
def nearest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_neighbor(fixture(spark, sf_dir, "polygons"), fixture(spark, sf_dir, "points2d"), m.METRICS["polygons"])
    return near.select("point_id", "object_id", _r(c("dist")).alias("dist"))


@_query(f"{_ALL_SQUARES} SELECT point_id, label, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM (SELECT point_id, object_id, CAST(object_id % 3 AS BIGINT) AS label, {_LINF_V} AS d FROM points2d, v) GROUP BY point_id, label")
def nn_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = fixture(spark, sf_dir, "squares").withColumn("label", (c("object_id") % 3).cast("long"))
    near = neighbors.nn_per_cluster(labelled, fixture(spark, sf_dir, "points2d"), m.METRICS["squares"])
    return near.select("point_id", "label", "object_id", _r(c("dist")).alias("dist"))


_OVERLAP = "a.object_id < b.object_id AND abs(a.x0 - b.x0) <= (a.size + b.size) / 2 AND abs(a.y0 - b.y0) <= (a.size + b.size) / 2"


@_query(f"{with_sql('squares')} SELECT a.object_id AS a, b.object_id AS b FROM squares a JOIN squares b ON {_OVERLAP}")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_join(fixture(spark, sf_dir, "squares"), square_boxes)


@_query(f"{with_sql('cuboids')} SELECT a.object_id AS a, b.object_id AS b FROM cuboids a JOIN cuboids b ON a.object_id < b.object_id AND abs(a.x0 - b.x0) <= (a.w + b.w) / 2 AND abs(a.y0 - b.y0) <= (a.h + b.h) / 2 AND abs(a.z0 - b.z0) <= (a.d + b.d) / 2")
def overlap_join_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_join(fixture(spark, sf_dir, "cuboids"), cuboid_boxes)


@_query(f"{with_sql('squares')}, o AS (SELECT a.object_id AS a, b.object_id AS b FROM squares a JOIN squares b ON {_OVERLAP}) SELECT object_id FROM squares WHERE object_id IN (SELECT a FROM o UNION SELECT b FROM o)")
def intersects_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.intersects_any(fixture(spark, sf_dir, "squares"), square_boxes).select("object_id")


_THIN = f"""WITH RECURSIVE squares AS ({SQL['squares'][1]}),
o AS (SELECT a.object_id AS a, b.object_id AS b FROM squares a JOIN squares b ON {_OVERLAP}),
r(step, object_id, state) AS (
  SELECT 0, object_id, CASE WHEN object_id IN (SELECT b FROM o) THEN 0 ELSE 1 END FROM squares
  UNION ALL
  SELECT step + 1, object_id, CASE WHEN state <> 0 THEN state
      WHEN EXISTS (SELECT 1 FROM o JOIN r q ON q.object_id = o.a WHERE o.b = r.object_id AND q.state = 1) THEN 2
      WHEN NOT EXISTS (SELECT 1 FROM o JOIN r q ON q.object_id = o.a WHERE o.b = r.object_id AND q.state = 0) THEN 1 ELSE 0 END
  FROM r WHERE EXISTS (SELECT 1 FROM r WHERE state = 0))
SELECT object_id FROM r WHERE state = 1 AND step = (SELECT max(step) FROM r)"""


@_query(_THIN)
def thin_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.thin_non_overlapping(fixture(spark, sf_dir, "squares"), square_boxes)


@_query(f"""{_THIN.rsplit("SELECT object_id FROM r", 1)[0]}, kept AS (SELECT object_id FROM r WHERE state = 1 AND step = (SELECT max(step) FROM r)),
numbered AS (SELECT object_id, row_number() OVER (ORDER BY object_id) AS rank FROM squares),
leads AS (SELECT object_id, rank - row_number() OVER (ORDER BY object_id) AS lead_ FROM numbered JOIN kept USING (object_id)),
gaps AS (SELECT object_id, lead_ - COALESCE(lag(lead_) OVER (ORDER BY object_id), 0) AS gap FROM leads)
SELECT object_id FROM kept WHERE object_id < COALESCE((SELECT min(object_id) FROM gaps WHERE gap >= greatest(1, floor(0.05 * (SELECT count(*) FROM squares)))), 9223372036854775807)""")
def thin_until_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinning with the stop after a run of refused candidates."""
    squares = fixture(spark, sf_dir, "squares")
    return overlap.stop_after_rejects(squares, overlap.thin_non_overlapping(squares, square_boxes))


# --- clustering ----------------------------------------------------------------------------


def _in_root(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.lit("0"))


_LABELLED = f"""{with_sql('squares')}, s AS (SELECT CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y)),
l AS (SELECT object_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(size) AS size, any_value(theta) AS theta, arg_min(i, (round(dist, 9), i)) AS label, min(dist) AS dist FROM (SELECT squares.*, i, {_LINF_SQUARE} AS dist FROM squares, s) GROUP BY object_id)"""


def _labelled(spark: SparkSession, sf_dir: str, kind: str = "squares", scale: float = 1.0, seeds: list[list[float]] | None = None) -> DataFrame:
    rows = _in_root(fixture(spark, sf_dir, kind))
    where = seeds or [[v / scale for v in s] for s in _SEEDS]
    return kmeans.assign_nearest_centroid(rows, kmeans.centroid_table(rows, {"0": where}), m.METRICS[kind], 3)


@_query(f"{_LABELLED} SELECT object_id, label, round(dist, 6) AS dist FROM l")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("object_id", "label", _r(c("dist")).alias("dist"))


@_query(f"{_LABELLED} SELECT label, round(avg(x0 + 0.5 * size * cos(theta)), 6) AS x, round(avg(y0 + 0.5 * size * sin(theta)), 6) AS y, count(*) AS n FROM l GROUP BY label")
def update_centroids_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir), "squares", shifted_update=True))


def _updated(rows: DataFrame, axes: str = "xy") -> DataFrame:
    return rows.select(c("idx").cast("long").alias("label"), *(_r(F.get("c", F.lit(i))).alias(a) for i, a in enumerate(axes)), "n")


@_query(
    f"""{with_sql('ellipses')}, s AS (SELECT CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y)), near AS (SELECT * FROM ellipses, s),
l AS (SELECT object_id, any_value(h) AS h, any_value(k) AS k, arg_min(i, (round(d, 9), i)) AS label FROM {_ellipse_sql('near', 'object_id, h, k, i')} GROUP BY object_id)
SELECT label, round(avg(h), 6) AS x, round(avg(k), 6) AS y, count(*) AS n FROM l GROUP BY label"""
)
def update_centroids_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir, "ellipses"), "ellipses"))


_SEEDS3 = [[75.0, 75.0, 75.0], [225.0, 75.0, 225.0], [150.0, 225.0, 150.0]]


@_query(f"""{with_sql('cuboids')}, s AS (SELECT CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (VALUES (0, 75.0, 75.0, 75.0), (1, 225.0, 75.0, 225.0), (2, 150.0, 225.0, 150.0)) AS s(i, x, y, z)),
l AS (SELECT object_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(z0) AS z0, arg_min(i, (round(dist, 9), i)) AS label FROM (SELECT cuboids.*, i, {_LINF_CUBOID} AS dist FROM cuboids, s) GROUP BY object_id)
SELECT label, round(avg(x0), 6) AS x, round(avg(y0), 6) AS y, round(avg(z0), 6) AS z, count(*) AS n FROM l GROUP BY label""")
def update_centroids_cuboids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir, "cuboids", seeds=_SEEDS3), "cuboids"), "xyz")


_UNIT_SEEDS = "s AS (SELECT CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) / 300 AS x, CAST(y AS DOUBLE) / 300 AS y FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y))"


@_query(f"""{with_sql('segments2d')}, {_UNIT_SEEDS}, l AS (SELECT object_id, any_value(x0 + length * cos(theta) / 2) AS mx, any_value(y0 + length * sin(theta) / 2) AS my, arg_min(i, (round(dist, 9), i)) AS label FROM (SELECT segments2d.*, i, {_SEG2} AS dist FROM segments2d, s) GROUP BY object_id)
SELECT label, round(avg(mx), 6) AS x, round(avg(my), 6) AS y, count(*) AS n FROM l GROUP BY label""")
def update_centroids_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir, "segments2d", 300.0), "segments2d"))


@_query(f"""{with_sql('vertices')}, {_EDGES}, s AS (SELECT CAST(i AS BIGINT) AS s, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y)),
d AS (SELECT object_id, s, min({_edge_sql('x', 'y', 'ax', 'ay', 'ex', 'ey')}) AS dist FROM edges, s GROUP BY object_id, s), l AS (SELECT object_id, arg_min(s, (round(dist, 9), s)) AS label FROM d GROUP BY object_id)
SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(DISTINCT object_id) AS n FROM vertices JOIN l USING (object_id) GROUP BY label""")
def update_centroids_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir, "polygons"), "polygons"))


@_query(f"{_LABELLED} SELECT count(*) AS n, round(sum(dist), 3) AS div_sum, round(avg(dist), 6) AS div_mean FROM l")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.divergence(_labelled(spark, sf_dir)).select("n", _r(c("div_sum"), 3).alias("div_sum"), _r(c("div_mean")).alias("div_mean"))


_FAR = "(VALUES (0, 75.0, 75.0), (1, 9000.0, 9000.0), (2, 150.0, 225.0))"


@_query(_LABELLED.replace("(VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0))", _FAR) + " SELECT label, round(avg(x0), 6) AS x, round(avg(y0), 6) AS y, count(*) AS n FROM l GROUP BY label")
def drop_empty_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed is out of reach, so its cluster stays empty and disappears."""
    return _updated(kmeans.update_centroids(_labelled(spark, sf_dir, seeds=[_SEEDS[0], [9000.0, 9000.0], _SEEDS[2]]), "squares"))


@_query(_LABELLED.replace("(VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0))", _FAR) + " SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS dense FROM l GROUP BY label")
def relabel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.relabel_dense(_labelled(spark, sf_dir, seeds=[_SEEDS[0], [9000.0, 9000.0], _SEEDS[2]])).select("label", "dense")


def _kmeans_sql(rounds: int) -> str:
    parts = [f"{with_sql('squares')}, c0 AS (SELECT CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (0, 75.0, 75.0), (1, 225.0, 75.0), (2, 150.0, 225.0)) AS s(i, x, y))"]
    for n in range(rounds + 1):
        parts.append(f"l{n} AS MATERIALIZED (SELECT object_id, any_value(x0) AS x0, any_value(y0) AS y0, arg_min(i, (round(dist, 9), i)) AS label, min(dist) AS dist FROM (SELECT squares.*, i, {_LINF_SQUARE} AS dist FROM squares, c{n}) GROUP BY object_id)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT label AS i, avg(x0) AS x, avg(y0) AS y FROM l{n} GROUP BY label)")
    return ", ".join(parts) + f" SELECT object_id, label, round(dist, 6) AS dist FROM l{rounds}"


@_query(_kmeans_sql(3))
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _in_root(fixture(spark, sf_dir, "squares"))
    labelled, _, _ = kmeans.kmeans_fit(rows, m.METRICS["squares"], kmeans.centroid_table(rows, {"0": _SEEDS}), 3, 3)
    return labelled.select("object_id", "label", _r(c("dist")).alias("dist"))


def _seed_sql(k: int = 3) -> str:
    parts = [f"{with_sql('squares')}, s0 AS MATERIALIZED (SELECT 0 AS idx, x0 AS x, y0 AS y FROM squares ORDER BY -ln({_uniform_sql('object_id', 0)}), object_id LIMIT 1)"]
    for i in range(1, k):
        near = f"SELECT object_id, any_value(x0) AS x0, any_value(y0) AS y0, arg_min(dist, (round(dist, 9), idx)) AS dist FROM (SELECT squares.*, idx, {_LINF_SQUARE} AS dist FROM squares, s{i - 1}) GROUP BY object_id"
        parts.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL (SELECT {i} AS idx, x0 AS x, y0 AS y FROM ({near}) ORDER BY CASE WHEN dist > 0 THEN -ln({_uniform_sql('object_id', i)}) / dist ELSE CAST('inf' AS DOUBLE) END, object_id LIMIT 1))")
    return ", ".join(parts) + f" SELECT '0' AS path, idx, round(x, 6) AS x, round(y, 6) AS y FROM s{k - 1}"


@_query(_seed_sql())
def kmeanspp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = kmeans.kmeanspp_seed(_in_root(fixture(spark, sf_dir, "squares")), m.METRICS["squares"], 3)
    return seeds.select("path", "idx", *(_r(F.get("c", F.lit(i))).alias(a) for i, a in enumerate("xy")))


# --- grids ---------------------------------------------------------------------------------

_ROOT_BOX = "b AS (SELECT min(x0) - max(size) AS lx, max(x0) + max(size) AS hx, min(y0) - max(size) AS ly, max(y0) + max(size) AS hy FROM squares)"


def _root(spark: SparkSession, sf_dir: str, kind: str = "squares") -> DataFrame:
    return grids.bounding_boxes(_in_root(fixture(spark, sf_dir, kind)), kind)


def _spread(rows: DataFrame, key: str = "grid_id") -> DataFrame:
    return rows.select(key, *(_r(F.get("p", F.lit(i))).alias(a) for i, a in enumerate("xy")))


@_query(f"{with_sql('squares')}, {_ROOT_BOX} SELECT i AS grid_id, round(lx + (hx - lx) * (i % 30) / 29, 6) AS x, round(ly + (hy - ly) * (i // 30) / 29, 6) AS y FROM b, range(900) AS r(i)")
def uncertainty_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(grids.lattice(_root(spark, sf_dir), 30, 2))


_BORDER = f"""{with_sql('squares')}, {_ROOT_BOX}, g AS (SELECT i AS grid_id, lx + (hx - lx) * (i % 60) / 59 AS x, ly + (hy - ly) * (i // 60) / 59 AS y, greatest(hx - lx, hy - ly) AS scale FROM b, range(3600) AS r(i)),
e AS (SELECT *, greatest(abs(x - 75), abs(y - 75)) AS e0, greatest(abs(x - 225), abs(y - 75)) AS e1, greatest(abs(x - 150), abs(y - 225)) AS e2 FROM g), f AS (SELECT *, least(e0, e1, e2) AS least_, 0.15 * scale AS eps FROM e)"""


def _rivals(eps: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {e} - least_ <= {eps} AND {e} <> least_ THEN 1 ELSE 0 END" for e in ("e0", "e1", "e2")) + ")"


@_query(f"{_BORDER}, k AS (SELECT *, row_number() OVER (ORDER BY grid_id) AS n FROM f WHERE {_rivals('eps')} > 1 OR ({_rivals('eps')} = 1 AND {_rivals('(eps / (least_ * 0.002))')} > 0)) SELECT grid_id, round(x, 6) AS x, round(y, 6) AS y FROM k WHERE n <= 900")
def uncertainty_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _root(spark, sf_dir)
    cents = kmeans.centroid_table(nodes, {"0": _SEEDS})
    return _spread(grids.uncertainty_points(grids.border_lattice(nodes, cents, 60, 2, 0.15), cents, nodes, 0.15, 2, 899))


@_query(f"{with_sql('squares')}, {_ROOT_BOX} SELECT i AS grid_id, round(lx + (hx - lx) * (i // 17) / 16, 6) AS x, round(ly + (hy - ly) * (i % 17) / 16, 6) AS y FROM b, range(289) AS r(i)")
def serialised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(grids.lattice(_root(spark, sf_dir), 17, 2, last_fastest=True))


@_query(f"{with_sql('squares')}, {_ROOT_BOX}, g AS (SELECT i AS grid_id, lx + (hx - lx) * (i % 60) / 59 AS x, ly + (hy - ly) * (i // 60) / 59 AS y FROM b, range(3600) AS r(i)), e AS (SELECT grid_id, greatest(abs(x - 75), abs(y - 75)) AS e0, greatest(abs(x - 225), abs(y - 75)) AS e1, greatest(abs(x - 150), abs(y - 225)) AS e2 FROM g) SELECT grid_id, round(least(e0, e1, e2), 6) AS energy, CAST(CASE WHEN e0 <= e1 AND e0 <= e2 THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END AS BIGINT) AS label FROM e")
def energy_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _root(spark, sf_dir)
    return grids.energy_surface(grids.lattice(nodes, 60, 2), kmeans.centroid_table(nodes, {"0": _SEEDS}), 3).select("grid_id", _r(c("energy")).alias("energy"), "label")


@_query(f"{with_sql('squares')}, {_ROOT_BOX} SELECT CAST(i // 300 AS BIGINT) AS repeat, i AS point_id, round(lx + (hx - lx) * {_uniform_sql('i', 1)}, 6) AS x, round(ly + (hy - ly) * {_uniform_sql('i', 8)}, 6) AS y FROM b, range(1200) AS r(i)")
def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grids.random_points(_root(spark, sf_dir), 300, 4, 2)
    return rows.select("repeat", "point_id", *(_r(F.get("p", F.lit(i))).alias(a) for i, a in enumerate("xy")))


@_query(f"{with_sql('squares')} SELECT object_id, x0, y0, size FROM squares ORDER BY {_uniform_sql('object_id', 0)}, object_id LIMIT 100")
def random_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.random_sample_n(fixture(spark, sf_dir, "squares"), 100).select("object_id", "x0", "y0", "size")


@_query(f"{with_sql('squares')} SELECT floor(min(x0) - 2 * max(size)) AS x0_lo, ceil(max(x0) + 2 * max(size)) AS x0_hi, floor(min(y0) - 2 * max(size)) AS y0_lo, ceil(max(y0) + 2 * max(size)) AS y0_hi FROM squares")
def bbox_centers_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.bbox_centers_sizes(fixture(spark, sf_dir, "squares"), [("x0", "size"), ("y0", "size")])


@_query(
    f"""{with_sql('squares', 'cuboids', 'ellipses', 'segments2d', 'segments3d', 'vertices')}
SELECT 'squares' AS kind, round(min(x0) - max(size), 6) AS x_lo, round(max(x0) + max(size), 6) AS x_hi, round(min(y0) - max(size), 6) AS y_lo, round(max(y0) + max(size), 6) AS y_hi FROM squares
UNION ALL SELECT 'cuboids', round(min(x0) - max(w), 6), round(max(x0) + max(w), 6), round(min(y0) - max(h), 6), round(max(y0) + max(h), 6) FROM cuboids
UNION ALL SELECT 'ellipses', round(min(h) - max(a), 6), round(max(h) + max(a), 6), round(min(k) - max(b), 6), round(max(k) + max(b), 6) FROM ellipses
UNION ALL SELECT 'segments2d', round(min(x0 - length), 6), round(max(x0 + length), 6), round(min(y0 - length), 6), round(max(y0 + length), 6) FROM segments2d
UNION ALL SELECT 'segments3d', round(min(x0 - length), 6), round(max(x0 + length), 6), round(min(y0 - length), 6), round(max(y0 + length), 6) FROM segments3d
UNION ALL SELECT 'polygons', round(min(x), 6), round(max(x), 6), round(min(y), 6), round(max(y), 6) FROM vertices"""
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in m.METRICS:
        b = lambda i, end: _r(F.get("bbox", F.lit(i))[end])
        rows = _root(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), b(0, "lo").alias("x_lo"), b(0, "hi").alias("x_hi"), b(1, "lo").alias("y_lo"), b(1, "hi").alias("y_hi"))
        out = rows if out is None else out.union(rows)
    return out


@_query(f"{_LABELLED} SELECT object_id, '0' || label AS path FROM l")
def divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.divide(_labelled(spark, sf_dir)).select("object_id", "path")


_SEGMENTS = m.METRICS["segments2d"]

# --- tree and routers ----------------------------------------------------------------------

#: A node of more objects is split; rounds of k-means; lattice points per axis of a node, points
#: kept, and width of a decision border.
THRESHOLD, ROUNDS, LATTICE, BORDER, EPSILON = 300, 10, 30, 899, 0.15
#: Routers of the registered queries: units, layers, epochs and rate. The operator's defaults are
#: larger (see the README).
ROUTER = (24, 2, 150, 0.02)


def _stored(spark: SparkSession, sf_dir: str, name: str, make: Query, anew: bool = False) -> DataFrame:
    """A table of the tree that is saved in the shared folder: the session remembers where, and
    what isn't there yet, or is wanted anew, is made and saved."""
    mark = f"orbitree.saved.{name}.{sf_dir}"
    path = spark.conf.get(mark, None)
    if path is None or anew:
        path = _fresh(spark, name)
        make(spark, sf_dir).write.parquet(path)
        spark.conf.set(mark, path)
    return spark.read.parquet(path)


def _nodes(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        assign, nodes = tree.build_tree(fixture(spark, sf_dir, "segments2d"), _SEGMENTS, THRESHOLD, 3, ROUNDS)
        _stored(spark, sf_dir, "assign", lambda *_: assign, True)
        return nodes

    return _stored(spark, sf_dir, "nodes", make, anew)


def _assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    _nodes(spark, sf_dir)
    return _stored(spark, sf_dir, "assign", lambda *_: None)


def _labelled_border(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    """Points near the decision borders of all inner nodes, with the child that is right."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        inner = _nodes(spark, sf_dir).where("!is_leaf")
        cents = inner.select("path", F.posexplode("centroids").alias("idx", "c"))
        border = materialize(grids.uncertainty_points(grids.border_lattice(inner, cents, LATTICE, 2, EPSILON), cents, inner, EPSILON, 2, BORDER), "border")
        held = router.prefixes(_assign(spark, sf_dir), _SEGMENTS).where(F.length("node") > 1)
        children = held.select("object_id", *_SEGMENTS.columns, F.expr("substring(node, 1, length(node) - 1)").alias("path"), F.expr("substring(node, length(node), 1)").alias("label"))
        labelled = router.label_uncertainty(border, materialize(children, "children"), _SEGMENTS)
        return labelled.join(inner.select("path", F.size("centroids").alias("children")), "path")

    return _stored(spark, sf_dir, "labelled", make, anew)


def _routers(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    return _stored(spark, sf_dir, "routers", lambda spark, sf_dir: router.fit_router(_labelled_border(spark, sf_dir), *ROUTER), anew)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(assign, nodes, routers, routing table) of the 2-D segments, from the saved tables."""
    nodes, routers = _nodes(spark, sf_dir), _routers(spark, sf_dir)
    return _assign(spark, sf_dir), nodes, routers, router.inner_nodes(nodes, routers)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "unit_points").select("point_id", "x", "y")


@_query()
def build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built anew at each call; the other queries read what was saved."""
    _nodes(spark, sf_dir, anew=True)
    return _assign(spark, sf_dir).select("object_id", "path")


@_query()
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_leaves(_nodes(spark, sf_dir))


@_query()
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_stats(_nodes(spark, sf_dir))


@_query()
def save_load_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved with its routers, loaded, and the objects assigned again from the root."""
    assign, nodes, routers, _ = _tree(spark, sf_dir)
    path = _fresh(spark, "saved")
    tree.save_tree(assign, nodes, path, routers)
    again, _ = tree.load_tree(spark, path, fixture(spark, sf_dir, "segments2d"), _SEGMENTS)
    return again.select("object_id", "path")


@_query()
def label_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_border(spark, sf_dir, anew=True).select("path", "grid_id", "label")


@_query()
def fit_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routers(spark, sf_dir, anew=True).select("path", F.size("weights").cast("long").alias("n_weights"), F.round("accuracy", 4).alias("accuracy"))


@_query()
def router_training_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.router_training_accuracy(_routers(spark, sf_dir))


@_query()
def score_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.score_router(_points(spark, sf_dir), _tree(spark, sf_dir)[3], 2)


@_query()
def router_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root router's choice over a lattice."""
    _, nodes, _, table = _tree(spark, sf_dir)
    spots = grids.lattice(nodes.where("path = '0'"), 60, 2).select(c("grid_id").alias("point_id"), *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))
    return router.score_router(spots, {"0": table["0"]}, 2)


@_query()
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf number that a lattice point is routed to."""
    _, nodes, _, table = _tree(spark, sf_dir)
    spots = grids.lattice(nodes.where("path = '0'"), 44, 2, last_fastest=True).select(c("grid_id").alias("point_id"), *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))
    leaf = router.route_greedy(spots, table, 2).select("point_id", F.element_at("visited", -1).alias("path"))
    return leaf.withColumn("cluster", g.path_to_int(c("path"), 3))


@_query()
def route_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.route_greedy(_points(spark, sf_dir), _tree(spark, sf_dir)[3], 2).select("point_id", F.element_at("visited", -1).alias("path"))


@_query()
def route_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a stream of files; the routes are those of the batch."""
    from orbitree.streaming.routing import route_stream as route

    source, out = _fresh(spark, "stream"), _fresh(spark, "routes")
    points = _points(spark, sf_dir)
    points.repartition(4).write.parquet(source)
    route(spark.readStream.schema(points.schema).parquet(source), _tree(spark, sf_dir)[3], 2, out, _fresh(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("point_id", F.element_at("visited", -1).alias("path"))


@_query()
def query_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, _, _, table = _tree(spark, sf_dir)
    return router.query_tree(_points(spark, sf_dir), table, assign, _SEGMENTS)


@_query()
def query_tree_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, _, _, table = _tree(spark, sf_dir)
    return router.query_tree_verbose(_points(spark, sf_dir), table, assign, _SEGMENTS)


def _by_sums(spark: SparkSession, sf_dir: str, running: bool) -> DataFrame:
    assign, _, _, table = _tree(spark, sf_dir)
    return router.query_leaf(router.route_by_sums(_points(spark, sf_dir), table, 2, running), assign, _SEGMENTS)


@_query()
def query_maxsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sums(spark, sf_dir, False)


@_query()
def query_maxcumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sums(spark, sf_dir, True)


@_query()
def query_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest object in the leaves that a beam of two reaches."""
    assign, _, _, table = _tree(spark, sf_dir)
    points = _points(spark, sf_dir)
    leaves = router.route_beam(points, table, 2, 2, 2.0)
    near = router.query_leaf(leaves.join(points, "point_id"), assign, _SEGMENTS)
    return near.groupBy("point_id").agg(F.min(F.struct(F.round("dist", 9).alias("r"), "object_id", "dist")).alias("m")).select("point_id", "m.object_id", "m.dist")


@_query()
def exact_voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.exact_voronoi_cells(fixture(spark, sf_dir, "segments2d"), _points(spark, sf_dir), _SEGMENTS, _assign(spark, sf_dir))


@_query()
def critic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every router over random points of the root's box."""
    assign, nodes, _, table = _tree(spark, sf_dir)
    spots = grids.random_points(nodes.where("path = '0'"), 300, 4, 2).select("point_id", *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))
    return accuracy.critic_accuracy(spots, table, assign, _SEGMENTS)


def _layers(spark: SparkSession, sf_dir: str, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int, int]:
    assign, nodes, _, table = _tree(spark, sf_dir)
    points = materialize(points, "points")
    answers = materialize(router.query_tree_verbose(points, table, assign, _SEGMENTS), "answers")
    exact = neighbors.knn(fixture(spark, sf_dir, "segments2d"), points, _SEGMENTS, k)
    return answers, exact, nodes.agg(F.max("depth")).first()[0], points.count()


@_query()
def layer_accuracy_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).where("path = '0'")
    spots = grids.random_points(nodes, 300, 4, 2).select("point_id", *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))
    return accuracy.layer_accuracy(*_layers(spark, sf_dir, spots, 1))


@_query()
def layer_accuracy_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).where("path = '0'")
    spots = grids.lattice(nodes, 22, 2, last_fastest=True).select(c("grid_id").alias("point_id"), *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))
    return accuracy.layer_accuracy(*_layers(spark, sf_dir, spots, 3))


@_query()
def layer_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.layer_query_counts(_layers(spark, sf_dir, _points(spark, sf_dir), 1)[0])


@_query()
def accuracy_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, _, _, table = _tree(spark, sf_dir)
    points = _points(spark, sf_dir)
    exact = neighbors.nearest_neighbor(fixture(spark, sf_dir, "segments2d"), points, _SEGMENTS)
    return accuracy.accuracy_with_ties(router.query_tree(points, table, assign, _SEGMENTS), exact)
