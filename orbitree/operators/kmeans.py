"""Metric k-means over geometric objects, for one set or for many groups (tree nodes) at once.

A group is named by the column ``path``. Centroids are a small table (path, idx, c array<double>),
at most 36 per group. Objects are never shuffled: each is compared with its group's centroids,
which come by a join on the path, and only sums per (path, label) move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitree.functions.metrics import METRICS, Metric
from orbitree.storage import materialize

MAX_K = 36


def centroid_table(df: DataFrame, groups: dict[str, list[list[float]]]) -> DataFrame:
    rows = [(path, i, [float(v) for v in c]) for path, cs in groups.items() for i, c in enumerate(cs)]
    return df.sparkSession.createDataFrame(rows, "path string, idx int, c array<double>")


def _arrayed(centroids: DataFrame) -> DataFrame:
    """One row per path: centroids in order of idx."""
    return centroids.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "c"))).alias("cs"))


def assign_nearest_centroid(objects: DataFrame, centroids: DataFrame, metric: Metric, k: int = MAX_K, few: bool = False) -> DataFrame:
    """objects with ``label`` (idx of the nearest centroid) and ``dist``; ties go to the smaller idx.
    ``few`` says that the number of paths has been checked to be small, so their row is broadcast."""
    o = metric.of()
    joined = objects.join(F.broadcast(_arrayed(centroids)) if few else _arrayed(centroids), "path")
    at = [F.get("cs", F.lit(i)) for i in range(k)]
    # the distances get a projection of their own, so each is computed once
    dists = joined.select("*", *(metric.distance(o, metric.at(c["c"])).alias(f"d{i}_") for i, c in enumerate(at)))
    each = [F.when(c.isNotNull(), F.struct(F.round(f"d{i}_", 9).alias("r"), c["idx"].alias("idx"), F.col(f"d{i}_").alias("dist"))) for i, c in enumerate(at)]
    best = F.least(*each) if k > 1 else each[0]
    return dists.select("*", best.alias("best_")).select(*objects.columns, F.col("best_.idx").cast("long").alias("label"), F.col("best_.dist").alias("dist"))


def contribution(kind: str | Metric, shifted_update: bool = False) -> tuple[list[Column], Column]:
    """What an object adds to its centroid: sums per axis and a weight.

    squares (shifted update): x + size/2 cos(theta), y + size/2 sin(theta); else the centre.
    ellipses and cuboids: the centre. segments: both ends. polygons: all vertices. A metric that isn't
    registered: its centre."""
    c = F.col
    one = F.lit(1.0)
    if isinstance(kind, Metric):
        if METRICS.get(kind.name) is not kind:
            return kind.centre(kind.of()), one
        kind = kind.name
    if kind == "squares" and shifted_update:
        return [c("x0") + c("size") * 0.5 * F.cos("theta"), c("y0") + c("size") * 0.5 * F.sin("theta")], one
    if kind == "polygons":
        return [F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["x"]), F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["y"])], F.size("vertices").cast("double")
    return METRICS[kind].centre(METRICS[kind].of()), one


def update_centroids(labelled: DataFrame, kind: str | Metric, shifted_update: bool = False) -> DataFrame:
    """(path, idx, c, n) of the groups that exist; labels without objects have no row."""
    sums, weight = contribution(kind, shifted_update)
    means = F.array(*(F.sum(s) / F.sum(weight) for s in sums))
    return labelled.groupBy("path", F.col("label").cast("int").alias("idx")).agg(means.alias("c"), F.count("*").alias("n"))


def divergence(labelled: DataFrame) -> DataFrame:
    """(path, n, div_sum, div_mean) of the distances to the nearest centroid."""
    return labelled.groupBy("path").agg(F.count("*").alias("n"), F.sum("dist").alias("div_sum"), F.avg("dist").alias("div_mean"))


def relabel_dense(labels: DataFrame) -> DataFrame:
    """(path, label, dense): used labels of each path renumbered from 0."""
    used = labels.select("path", "label").distinct()
    ordered = used.groupBy("path").agg(F.sort_array(F.collect_list("label")).alias("all_"))
    return ordered.select("path", F.posexplode("all_").alias("dense", "label")).select("path", "label", F.col("dense").cast("long").alias("dense"))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from an id and a seed, the same on every partitioning."""
    return ((key.cast("long") % 1000003 * 48271 + (seed * 69621 + 12345)) % 2147483647 * 16807 % 2147483647 + 0.5) / 2147483647.0


def kmeanspp_seed(objects: DataFrame, metric: Metric, k: int, seed: int = 0, few: bool = False) -> DataFrame:
    """(path, idx, c): k seeds per path, each drawn with chance in proportion to the distance to the
    seeds so far, as the least of -ln(u) / dist over hashed uniforms u. The first is drawn evenly."""
    centre = F.array(*metric.centre(metric.of()))
    chosen = None
    for i in range(k):
        u = -F.log(hashed_uniform(F.col("object_id"), seed * 31 + i))
        if chosen is None:
            rows, race = objects, u
        else:
            rows = assign_nearest_centroid(objects, chosen, metric, i, few)
            race = F.when(F.col("dist") > 0, u / F.when(F.col("dist") > 0, F.col("dist"))).otherwise(F.lit(float("inf")))
        draw = rows.withColumn("race", race).groupBy("path").agg(F.min(F.struct("race", "object_id", centre.alias("c"))).alias("m"))
        row = draw.select("path", F.lit(i).alias("idx"), F.col("m.c").alias("c"))
        chosen = materialize(row if chosen is None else chosen.union(row), "seeds")
    return chosen


def kmeans_fit(objects: DataFrame, metric: Metric, seeds: DataFrame, n_iter: int, k: int = MAX_K, shifted_update: bool = False, lagged_labels: bool = False, until_stable: bool = False, few: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled objects, centroids, divergence per round).

    Each round assigns, updates and drops empty clusters. After the last update the objects are
    assigned once more, unless ``lagged_labels`` keeps the labels from before it. ``until_stable``
    ends the rounds when no centroid has moved; more rounds would change nothing. Centroids are
    written after each round, or, if their paths are ``few``, after every fifth: they are broadcast
    then, so the rounds between pass over the objects without moving them."""
    centroids, history, labelled, written = seeds, None, None, seeds
    for i in range(n_iter):
        labelled = assign_nearest_centroid(objects, centroids, metric, k, few)
        step = divergence(labelled).withColumn("iteration", F.lit(i))
        history = step if history is None else history.union(step)
        centroids = update_centroids(labelled, metric, shifted_update).select("path", "idx", "c")
        if not few or i % 5 == 4 or i == n_iter - 1:
            centroids = materialize(centroids, "centroids")
            if until_stable and i % 5 == 4 and centroids.join(written.select("path", "idx", F.col("c").alias("c_")), ["path", "idx"], "full").where("c is null or c_ is null or c != c_").isEmpty():
                break
            written = centroids
    if not lagged_labels or labelled is None:
        labelled = assign_nearest_centroid(objects, centroids, metric, k, few)
    return labelled, centroids, history
