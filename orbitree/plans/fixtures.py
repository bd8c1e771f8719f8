"""Geometric objects and points as projections of the given tables.

Each projection is plain SQL that means the same in Spark and DuckDB, so queries and oracle see
the same rows. Ids are unique; all geometry is double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _xy(key: str) -> tuple[str, str]:
    return f"{_d(f'({key} * 7919) % 3001')} / {_d('10')}", f"{_d(f'({key} * 6271) % 2999')} / {_d('10')}"


_PX, _PY = _xy("p_partkey")
_CX, _CY = _xy("c_custkey")
_SEGMENT = f"""o_orderkey AS object_id, {_d('(o_orderkey * 7919) % 100003')} / {_d('100003')} AS x0, {_d('(o_custkey * 6271 + o_orderkey) % 99991')} / {_d('99991')} AS y0,
 {{z0}} {_d('0.00001')} + {_d('0.00999')} * {_d('o_totalprice')} / {_d('500000')} AS length, radians({_d('(o_orderkey * 31) % 180')}) AS theta"""

#: Name to (table, SQL).
SQL: dict[str, tuple[str, str]] = {
    "squares": ("part", f"SELECT p_partkey AS object_id, {_PX} AS x0, {_PY} AS y0, {_d('1 + p_size % 4')} AS size, radians({_d('(p_partkey * 31) % 90')}) AS theta FROM part"),
    "squares_raw": ("part", f"SELECT p_partkey AS object_id, {_PX} AS x0, {_PY} AS y0, {_d('1 + p_size % 4')} AS size, {_d('(p_partkey * 31) % 90')} AS theta FROM part"),
    "cuboids": (
        "part",
        f"SELECT p_partkey AS object_id, {_PX} AS x0, {_PY} AS y0, {_d('(p_partkey * 5407) % 2903')} / {_d('10')} AS z0, {_d('1 + p_size % 4')} AS w, {_d('1 + (p_size + p_partkey) % 4')} AS h, {_d('1 + (p_size * 3 + p_partkey) % 4')} AS d, {_d('0')} AS theta, {_d('0')} AS psi, {_d('0')} AS phi FROM part",
    ),
    "segments2d": ("orders", f"SELECT {_SEGMENT.format(z0='')} FROM orders"),
    "segments3d": ("orders", f"SELECT {_SEGMENT.format(z0=_d('(o_orderkey * 5407) % 99989') + ' / ' + _d('99989') + ' AS z0,')}, radians({_d('(o_orderkey * 17) % 360')}) AS phi FROM orders"),
    "ellipses": ("customer", f"SELECT c_custkey AS object_id, {_d('1')} + {_d('c_custkey % 21')} / {_d('10')} AS a, {_d('1')} + {_d('(c_custkey * 7) % 20')} / {_d('10')} AS b, {_CX} AS h, {_CY} AS k FROM customer"),
    "vertices": (
        "customer",
        f"""SELECT object_id, i, cx + r * cos(2 * pi() * i / m) AS x, cy + r * sin(2 * pi() * i / m) AS y, m FROM (
  SELECT object_id, i, m, cx, cy, {_d('0.8')} + {_d('(object_id * 13 + i * 7) % 11')} * {_d('0.24')} AS r FROM (
    SELECT c_custkey AS object_id, 3 + c_custkey % 8 AS m, {_CX} AS cx, {_CY} AS cy, i.i FROM customer CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS i(i)) AS v WHERE i < m) AS w""",
    ),
    "points2d": ("events", f"SELECT event_id AS point_id, {_d('(event_id * 4001) % 3001')} / {_d('10')} AS x, value * {_d('0.6')} AS y FROM events"),
    "points3d": ("events", f"SELECT event_id AS point_id, {_d('(event_id * 4001) % 3001')} / {_d('10')} AS x, value * {_d('0.6')} AS y, {_d('(event_id * 2003) % 2903')} / {_d('10')} AS z FROM events"),
    "unit_points": ("events", f"SELECT event_id AS point_id, {_d('(event_id * 4001) % 3001')} / {_d('3000')} AS x, value * {_d('0.6')} / {_d('300')} AS y, {_d('(event_id * 2003) % 2903')} / {_d('3000')} AS z FROM events"),
    "vectors": ("embeddings", "SELECT vec_id, embedding, label FROM embeddings"),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One projection as a DataFrame; polygons have a vertex array."""
    if name == "polygons":
        rows = fixture(spark, sf_dir, "vertices")
        ring = F.sort_array(F.collect_list(F.struct("i", "x", "y")))
        return rows.groupBy("object_id").agg(F.transform(ring, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))
    source, sql = SQL[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def with_sql(*names: str) -> str:
    """A WITH clause that defines the projections for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n][1]})" for n in names)
