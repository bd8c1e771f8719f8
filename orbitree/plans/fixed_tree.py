"""Queries over a tree of two levels whose centroids and linear routers are plain aggregates of the
2-D segments, so that SQL can repeat every route, sum and accuracy; and trees and k-means under metrics
that users add.

Centroids are the mean midpoints of the thirds of the unit square: three at the root, by x, and three
below each, by y. A router scores a child by 2 c.x - |c|^2, which names the nearest centroid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitree.functions.geometry import path_to_int
from orbitree.functions.metrics import METRICS, Metric, vector_metric
from orbitree.operators import accuracy, grids, kmeans, neighbors, router, tree
from orbitree.plans.catalog import _SEG2, _fresh, _r
from orbitree.plans.fixtures import fixture, with_sql
from orbitree.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_SEGMENTS = METRICS["segments2d"]
c = F.col


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- the tree in SQL -------------------------------------------------------------------------

_THIRD = "CAST(least(greatest(floor({} * 3), 0), 2) AS BIGINT)"
_SCORE = "2 * cx * x + 2 * cy * y - (cx * cx + cy * cy)"
_TREE = f"""{with_sql('segments2d', 'unit_points')},
middles AS (SELECT x0 + length * cos(theta) / 2 AS mx, y0 + length * sin(theta) / 2 AS my FROM segments2d),
thirds AS (SELECT mx, my, {_THIRD.format('mx')} AS t, {_THIRD.format('my')} AS u FROM middles),
c1 AS MATERIALIZED (SELECT t, round(avg(mx), 9) AS cx, round(avg(my), 9) AS cy FROM thirds GROUP BY t),
c2 AS MATERIALIZED (SELECT t, u, round(avg(mx), 9) AS cx, round(avg(my), 9) AS cy FROM thirds GROUP BY t, u),
a1 AS (SELECT object_id, arg_min(t, (round(d, 9), t)) AS t FROM (SELECT object_id, t, {_SEG2} AS d FROM segments2d, (SELECT t, cx AS x, cy AS y FROM c1)) GROUP BY object_id),
a2 AS (SELECT object_id, t, arg_min(u, (round(d, 9), u)) AS u FROM (SELECT object_id, t, u, {_SEG2} AS d FROM segments2d JOIN a1 USING (object_id) JOIN (SELECT t, u, cx AS x, cy AS y FROM c2) USING (t)) GROUP BY object_id, t),
held AS MATERIALIZED (SELECT segments2d.*, t, u FROM segments2d JOIN a2 USING (object_id)),
s1 AS MATERIALIZED (SELECT point_id, x, y, t, {_SCORE} AS s FROM unit_points, c1),
s2 AS MATERIALIZED (SELECT point_id, x, y, t, u, {_SCORE} AS s FROM unit_points, c2),
r1 AS MATERIALIZED (SELECT point_id, arg_max(t, (s, -t)) AS t FROM s1 GROUP BY point_id),
r2 AS MATERIALIZED (SELECT point_id, t, arg_max(u, (s, -u)) AS u FROM s2 JOIN r1 USING (point_id, t) GROUP BY point_id, t)"""
_FIRST = "arg_min(object_id, (round(d, 9), object_id)) AS object_id, min(d) AS dist"
#: The nearest object of each leaf to every point.
_NEAR = f"near AS MATERIALIZED (SELECT point_id, t, u, {_FIRST} FROM (SELECT point_id, t, u, object_id, {_SEG2} AS d FROM unit_points, held) GROUP BY point_id, t, u)"
_IN_NODE = "near1 AS (SELECT point_id, t, arg_min(object_id, (round(dist, 9), object_id)) AS object_id, min(dist) AS dist FROM near GROUP BY point_id, t), near0 AS (SELECT point_id, arg_min(object_id, (round(dist, 9), object_id)) AS object_id, min(dist) AS dist FROM near GROUP BY point_id)"
_PATH = "'0' || t || u"


def _in_leaf(routes: str) -> str:
    """The nearest object within the leaves that routes (point_id, t, u) name."""
    return f"SELECT point_id, {_PATH} AS path, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM (SELECT point_id, t, u, object_id, {_SEG2} AS d FROM {routes} JOIN unit_points USING (point_id) JOIN held USING (t, u)) GROUP BY point_id, t, u"


# --- the tree in Spark -----------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = [m.alias(n) for m, n in zip(_SEGMENTS.centre(_SEGMENTS.of()), ("mx", "my"))]
    third = lambda v: F.least(F.greatest(F.floor(c(v) * 3), F.lit(0)), F.lit(2)).cast("int")
    rows = fixture(spark, sf_dir, "segments2d").select(*middle).withColumn("t", third("mx")).withColumn("u", third("my"))
    mean = F.array(F.round(F.avg("mx"), 9), F.round(F.avg("my"), 9)).alias("c")
    gathered = lambda idx: F.transform(F.sort_array(F.collect_list(F.struct(idx, "c"))), lambda s: s["c"]).alias("centroids")
    root = rows.groupBy("t").agg(mean).groupBy(F.lit("0").alias("path")).agg(gathered("t"))
    below = materialize(rows.groupBy("t", "u").agg(mean), "means")
    inner = root.unionByName(below.groupBy(F.concat(F.lit("0"), c("t").cast("string")).alias("path")).agg(gathered("u")))
    leaves = below.select(F.concat(F.lit("0"), c("t").cast("string"), c("u").cast("string")).alias("path"), F.lit(None).cast("array<array<double>>").alias("centroids"))
    parent = F.expr("substring(path, 1, length(path) - 1)").alias("parent")
    nodes = inner.unionByName(leaves).select("path", parent, (F.length("path") - 1).alias("depth"), "centroids", c("centroids").isNull().alias("is_leaf"))
    return materialize(nodes, "nodes")


def _routers(nodes: DataFrame) -> DataFrame:
    """Linear routers in the form of fitted ones: no hidden layer, no scaling."""
    axis = lambda d: F.transform("centroids", lambda v: 2 * v[d])
    offset = F.transform("centroids", lambda v: -(v[0] * v[0] + v[1] * v[1]))
    weights = F.concat(F.array(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0))), axis(0), axis(1), offset)
    return nodes.where("!is_leaf").select("path", F.array(F.lit(2), F.size("centroids")).alias("shapes"), weights.alias("weights"), F.lit(1.0).alias("accuracy"), F.array(F.lit(1.0)).alias("history"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """(assign, routing table)."""
    nodes = _nodes(spark, sf_dir)
    assign = materialize(tree.assign_by_centroids(fixture(spark, sf_dir, "segments2d"), nodes, _SEGMENTS), "assign")
    return assign, router.inner_nodes(nodes, _routers(nodes))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "unit_points").select("point_id", "x", "y")


def _answer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dist", _r(c("dist")))


@_query(f"{_TREE} SELECT object_id, {_PATH} AS path FROM held")
def tree_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects walked to their leaves by nearest centroid, saved, loaded and walked again."""
    nodes = _nodes(spark, sf_dir)
    objects = fixture(spark, sf_dir, "segments2d")
    path = _fresh(spark, "fixed")
    tree.save_tree(tree.assign_by_centroids(objects, nodes, _SEGMENTS), nodes, path)
    return tree.load_tree(spark, path, objects, _SEGMENTS)[0].select("object_id", "path")


@_query(f"{_TREE} SELECT {_PATH} AS path, count(*) AS n FROM held GROUP BY t, u")
def tree_leaf_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0].groupBy("path").agg(F.count("*").alias("n"))


@_query(f"""{_TREE} SELECT point_id, '0' AS path, arg_max(t, (s, -t)) AS child, round(max(s), 6) AS best FROM s1 GROUP BY point_id
UNION ALL SELECT point_id, '0' || t, arg_max(u, (s, -u)), round(max(s), 6) FROM s2 GROUP BY point_id, t""")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.score_router(_points(spark, sf_dir), _tree(spark, sf_dir)[1], 2).withColumn("best", _r(c("best")))


@_query(f"{_TREE} SELECT point_id, {_PATH} AS path FROM r2")
def tree_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.route_greedy(_points(spark, sf_dir), _tree(spark, sf_dir)[1], 2).select("point_id", F.element_at("visited", -1).alias("path"))


@_query(f"{_TREE} SELECT point_id, {_PATH} AS path FROM r2")
def tree_routes_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a tree that was saved with its routers and loaded again."""
    nodes = _nodes(spark, sf_dir)
    path = _fresh(spark, "fixed")
    tree.save_tree(tree.assign_by_centroids(fixture(spark, sf_dir, "segments2d"), nodes, _SEGMENTS), nodes, path, _routers(nodes))
    saved = tree.load_snapshot(spark, path)
    return router.route_greedy(_points(spark, sf_dir), router.inner_nodes(saved.nodes, saved.routers), 2).select("point_id", F.element_at("visited", -1).alias("path"))


@_query(f"{_TREE} SELECT point_id, {_PATH} AS path FROM r2")
def tree_routes_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a stream of files."""
    from orbitree.streaming.routing import route_stream

    source, out = _fresh(spark, "stream"), _fresh(spark, "routes")
    points = _points(spark, sf_dir)
    points.repartition(4).write.parquet(source)
    route_stream(spark.readStream.schema(points.schema).parquet(source), _tree(spark, sf_dir)[1], 2, out, _fresh(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("point_id", F.element_at("visited", -1).alias("path"))


@_query(f"{_TREE} {_in_leaf('r2')}")
def tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    return _answer(router.query_tree(_points(spark, sf_dir), table, assign, _SEGMENTS))


@_query(f"""{_TREE}, {_NEAR}, {_IN_NODE} SELECT point_id, CAST(1 AS BIGINT) AS layer, '0' || t AS node, object_id, round(dist, 6) AS dist FROM r1 JOIN near1 USING (point_id, t)
UNION ALL SELECT point_id, 2, {_PATH}, object_id, round(dist, 6) FROM r2 JOIN near USING (point_id, t, u)""")
def tree_query_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    return _answer(router.query_tree_verbose(_points(spark, sf_dir), table, assign, _SEGMENTS))


def _sums_sql(running: bool) -> str:
    return f"sums AS MATERIALIZED (SELECT point_id, t, u, {'2 * ' if running else ''}s1.s + s2.s AS score FROM s1 JOIN s2 USING (point_id, t))"


def _leaf_sums(spark: SparkSession, sf_dir: str, running: bool) -> DataFrame:
    return router.leaf_sums(_points(spark, sf_dir), _tree(spark, sf_dir)[1], 2, running).withColumn("score", _r(c("score")))


def _by_sums(spark: SparkSession, sf_dir: str, running: bool) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    return _answer(router.query_leaf(router.route_by_sums(_points(spark, sf_dir), table, 2, running), assign, _SEGMENTS))


_BEST = "best AS (SELECT point_id, arg_max(t, (score, -t, -u)) AS t, arg_max(u, (score, -t, -u)) AS u FROM sums GROUP BY point_id)"


@_query(f"{_TREE}, {_sums_sql(False)} SELECT point_id, {_PATH} AS path, round(score, 6) AS score FROM sums")
def leaf_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_sums(spark, sf_dir, False)


@_query(f"{_TREE}, {_sums_sql(True)} SELECT point_id, {_PATH} AS path, round(score, 6) AS score FROM sums")
def leaf_cumsums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_sums(spark, sf_dir, True)


@_query(f"{_TREE}, {_sums_sql(False)}, {_BEST} {_in_leaf('best')}")
def tree_query_maxsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sums(spark, sf_dir, False)


@_query(f"{_TREE}, {_sums_sql(True)}, {_BEST} {_in_leaf('best')}")
def tree_query_maxcumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_sums(spark, sf_dir, True)


_BEAM = 0.3


@_query(f"""{_TREE}, b1 AS (SELECT point_id, t FROM (SELECT point_id, t, row_number() OVER w AS k, max(s) OVER (PARTITION BY point_id) - s AS gap FROM s1 WINDOW w AS (PARTITION BY point_id ORDER BY s DESC, t)) WHERE k <= 2 AND gap <= {_BEAM}),
o2 AS (SELECT point_id, t, u, s FROM s2 JOIN b1 USING (point_id, t)),
b2 AS (SELECT point_id, t, u FROM (SELECT point_id, t, u, row_number() OVER (PARTITION BY point_id ORDER BY s DESC, t, u) AS k, max(s) OVER (PARTITION BY point_id) - s AS gap FROM o2) WHERE k <= 2 AND gap <= {_BEAM}),
found AS ({_in_leaf('b2')}) SELECT point_id, path, object_id, dist FROM found""")
def tree_query_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest object in each leaf that a beam of two reaches."""
    assign, table = _tree(spark, sf_dir)
    points = _points(spark, sf_dir)
    leaves = router.route_beam(points, table, 2, 2, _BEAM)
    return _answer(router.query_leaf(leaves.join(points, "point_id"), assign, _SEGMENTS))


@_query(f"""{_TREE}, {_NEAR}, {_IN_NODE}, hits AS (SELECT '0' AS path, COALESCE(near1.object_id = near0.object_id, false) AS hit FROM r1 JOIN near0 USING (point_id) LEFT JOIN near1 USING (point_id, t)
UNION ALL SELECT '0' || t, COALESCE(near.object_id = near1.object_id, false) FROM (SELECT point_id, t, arg_max(u, (s, -u)) AS u FROM s2 GROUP BY point_id, t) JOIN near1 USING (point_id, t) LEFT JOIN near USING (point_id, t, u))
SELECT path, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy FROM hits GROUP BY path""")
def tree_critic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    return accuracy.critic_accuracy(_points(spark, sf_dir), table, assign, _SEGMENTS).withColumn("accuracy", _r(c("accuracy")))


@_query(f"""{_TREE}, {_NEAR}, {_IN_NODE}, l AS (SELECT r2.point_id, a.object_id = e.object_id AS first, b.object_id = e.object_id AS second FROM r2 JOIN near1 a USING (point_id, t) JOIN near b ON b.point_id = r2.point_id AND b.t = r2.t AND b.u = r2.u JOIN near0 e ON e.point_id = r2.point_id)
SELECT CAST(1 AS BIGINT) AS layer, round(100.0 * avg(CAST(first AS DOUBLE)), 6) AS accuracy FROM l UNION ALL SELECT 2, round(100.0 * avg(CAST(first AND second AS DOUBLE)), 6) FROM l""")
def tree_layer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    points = materialize(_points(spark, sf_dir), "points")
    answers = materialize(router.query_tree_verbose(points, table, assign, _SEGMENTS), "answers")
    exact = neighbors.knn(fixture(spark, sf_dir, "segments2d"), points, _SEGMENTS, 1)
    return accuracy.layer_accuracy(answers, exact, 2, points.count()).withColumn("accuracy", _r(c("accuracy")))


@_query(f"{_TREE} SELECT CAST(1 AS BIGINT) AS layer, count(*) AS n_queries FROM r1 UNION ALL SELECT 2, count(*) FROM r2")
def tree_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    return accuracy.layer_query_counts(router.query_tree_verbose(_points(spark, sf_dir), table, assign, _SEGMENTS))


@_query(f"""{_TREE}, {_NEAR}, {_IN_NODE} SELECT count(*) AS n, round(avg(CAST(a.object_id = e.object_id AS DOUBLE)), 6) AS same_object, round(avg(CAST(a.object_id = e.object_id OR abs(a.dist - e.dist) <= 1e-9 AS DOUBLE)), 6) AS same_or_tied
FROM r2 JOIN near a USING (point_id, t, u) JOIN near0 e ON e.point_id = r2.point_id""")
def tree_accuracy_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    assign, table = _tree(spark, sf_dir)
    points = _points(spark, sf_dir)
    exact = neighbors.nearest_neighbor(fixture(spark, sf_dir, "segments2d"), points, _SEGMENTS)
    found = accuracy.accuracy_with_ties(router.query_tree(points, table, assign, _SEGMENTS), exact)
    return found.select("n", _r(c("same_object")).alias("same_object"), _r(c("same_or_tied")).alias("same_or_tied"))


@_query(f"{_TREE}, {_NEAR}, {_IN_NODE} SELECT point_id, near0.object_id, round(dist, 6) AS dist, {_PATH} AS path FROM near0 JOIN held USING (object_id)")
def tree_voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(grids.exact_voronoi_cells(fixture(spark, sf_dir, "segments2d"), _points(spark, sf_dir), _SEGMENTS, _tree(spark, sf_dir)[0]))


@_query(f"{_TREE}, {_NEAR} SELECT '0' AS path, point_id AS grid_id, arg_min(t, (round(dist, 9), t)) AS label FROM near GROUP BY point_id")
def tree_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's child that holds the nearest object of each point."""
    points = _points(spark, sf_dir).select(F.lit("0").alias("path"), c("point_id").alias("grid_id"), F.array("x", "y").alias("p"))
    children = _tree(spark, sf_dir)[0].withColumn("label", F.substring("path", 2, 1)).withColumn("path", F.lit("0"))
    return router.label_uncertainty(points, children, _SEGMENTS).select("path", "grid_id", "label")


_LATTICE = 44


def _spots(spark: SparkSession) -> DataFrame:
    box = spark.range(1).select(F.lit("0").alias("path"), F.array(*(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")) for _ in "xy")).alias("bbox"))
    return grids.lattice(box, _LATTICE, 2, last_fastest=True).select(c("grid_id").alias("point_id"), *(F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xy")))


@_query(f"""{_TREE}, g AS (SELECT i AS point_id, CAST(i // {_LATTICE} AS DOUBLE) / {_LATTICE - 1} AS x, CAST(i % {_LATTICE} AS DOUBLE) / {_LATTICE - 1} AS y FROM (SELECT unnest(range({_LATTICE * _LATTICE})) AS i)),
g1 AS (SELECT point_id, any_value(x) AS x, any_value(y) AS y, arg_max(t, (s, -t)) AS t FROM (SELECT point_id, x, y, t, {_SCORE} AS s FROM g, c1) GROUP BY point_id),
g2 AS (SELECT point_id, t, arg_max(u, (s, -u)) AS u FROM (SELECT point_id, t, u, {_SCORE} AS s FROM g1 JOIN c2 USING (t)) GROUP BY point_id, t)
SELECT point_id, {_PATH} AS path, CAST(27 + 3 * t + u AS BIGINT) AS cluster FROM g2""")
def tree_cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf number that a lattice point is routed to."""
    leaf = router.route_greedy(_spots(spark), _tree(spark, sf_dir)[1], 2).select("point_id", F.element_at("visited", -1).alias("path"))
    return leaf.withColumn("cluster", path_to_int(c("path"), 3))


# --- metrics that users add ------------------------------------------------------------------

#: Discs as a user would add them: distance to the disc, 0 inside.
DISCS = Metric(
    "discs",
    ("cx", "cy", "r"),
    2,
    lambda o, p: F.greatest(F.sqrt((o["cx"] - p[0]) * (o["cx"] - p[0]) + (o["cy"] - p[1]) * (o["cy"] - p[1])) - o["r"], F.lit(0.0)),
    lambda o: [(o["cx"] - o["r"], o["cx"] + o["r"]), (o["cy"] - o["r"], o["cy"] + o["r"])],
    lambda o: [o["cx"], o["cy"]],
    lambda o: [o["cx"], o["cy"]],
)
_DISC = "greatest(sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) - r, CAST(0 AS DOUBLE))"
_DISCS = "discs AS (SELECT object_id, x0 AS cx, y0 AS cy, size / 2 AS r FROM squares)"


def _discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "squares").select("object_id", c("x0").alias("cx"), c("y0").alias("cy"), (c("size") / 2).alias("r"))


@_query(f"{with_sql('squares', 'points2d')}, {_DISCS} SELECT point_id, arg_min(object_id, (round(d, 9), object_id)) AS object_id, round(min(d), 6) AS dist FROM (SELECT point_id, object_id, {_DISC} AS d FROM points2d, discs) GROUP BY point_id")
def user_metric_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(neighbors.nearest_neighbor(_discs(spark, sf_dir), fixture(spark, sf_dir, "points2d"), DISCS))


@_query()
def user_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest disc in the leaf that nearest-centroid routing reaches, in a tree of discs."""
    assign, nodes = tree.build_tree(_discs(spark, sf_dir), DISCS, 200, 3, 5)
    return router.query_tree(fixture(spark, sf_dir, "points2d"), router.inner_nodes(nodes, None), assign, DISCS)


_SEED_IDS = (0, 1, 2)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Metric]:
    return fixture(spark, sf_dir, "vectors").select(c("vec_id").alias("object_id"), "embedding"), vector_metric("embedding", 64)


def _kmeans_sql(rounds: int) -> str:
    near = "list_max(list_transform(range(1, 65), lambda i: abs(v[i] - c[i])))"
    steps = ["v AS MATERIALIZED (SELECT vec_id AS object_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", f"k0 AS (SELECT row_number() OVER (ORDER BY object_id) - 1 AS idx, v AS c FROM v WHERE object_id IN {_SEED_IDS})"]
    for i in range(rounds + 1):
        steps.append(f"l{i} AS MATERIALIZED (SELECT object_id, any_value(v) AS v, arg_min(idx, (round(d, 9), idx)) AS label, min(d) AS dist FROM (SELECT object_id, v, idx, {near} AS d FROM v, k{i}) GROUP BY object_id)")
        steps.append(f"k{i + 1} AS MATERIALIZED (SELECT label AS idx, list(m ORDER BY j) AS c FROM (SELECT label, j, avg(v[j]) AS m FROM l{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY label, j) GROUP BY label)")
    return f"WITH {', '.join(steps)} SELECT object_id, label, round(dist, 6) AS dist FROM l{rounds}"


@_query(_kmeans_sql(3))
def kmeans_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of the 64-dimensional vectors from three given seeds, three rounds."""
    objects, metric = _vectors(spark, sf_dir)
    rows = materialize(objects.withColumn("path", F.lit("0")), "vectors")
    seeds = rows.where(c("object_id").isin(*_SEED_IDS)).select("path", (F.dense_rank().over(Window.partitionBy("path").orderBy("object_id")) - 1).alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("c"))
    labelled, _, _ = kmeans.kmeans_fit(rows, metric, materialize(seeds, "seeds"), 3, 3, few=True)
    return labelled.select("object_id", "label", _r(c("dist")).alias("dist"))


@_query()
def vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vector in the leaf that nearest-centroid routing reaches, in 64 dimensions."""
    objects, metric = _vectors(spark, sf_dir)
    assign, nodes = tree.build_tree(objects, metric, 200, 3, 5)
    points = objects.select(c("object_id").alias("point_id"), F.transform("embedding", lambda v: v.cast("double")).alias("p"))
    return router.query_tree(points, router.inner_nodes(nodes, None), assign, metric)
