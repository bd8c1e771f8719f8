"""Per-node routers: small classifiers that send a point to a child, and the queries through them.

A router is a multi-layer perceptron fitted on the uncertainty points of its node, each labelled
with the child that holds its nearest object. Fitting is one ``applyInPandas`` group per node with
at most m + 1 rows. Routing runs in place over the points: the node table (weights, not objects)
is collected after a check of its bytes and shipped with the function. A larger table is dealt to parts
that fit, level by level, each one pass over the points (``Parts``); the answers are the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitree.functions.metrics import Metric
from orbitree.operators.neighbors import nearest_neighbor
from orbitree.operators.tree import DIGITS
from orbitree.storage import materialize

#: Bytes of weights and centroids that are shipped to tasks at once.
MAX_BYTES = 256 << 20
#: Bytes of a node besides its numbers, about.
_NODE_BYTES = 400

_ROUTER = "path string, shapes array<int>, weights array<double>, accuracy double, history array<double>"


def label_uncertainty(points: DataFrame, children: DataFrame, metric: Metric) -> DataFrame:
    """(path, grid_id, p, label): the child whose nearest object is closest to each point.

    children: (object_id, object columns, path, label), objects with their node and the child's digit."""
    axes = metric.axes
    named = points.withColumn("point_id", F.xxhash64("path", "grid_id"))
    spots = named.select("point_id", *(v.alias(a) for v, a in zip(metric.at(F.col("p")), axes)))
    groups = children.withColumn("child", F.concat("path", F.col("label").cast("string")))
    asked = named.select("point_id", "path").join(groups.select("path", "child").distinct(), "path").select("point_id", "child")
    near = nearest_neighbor(groups, spots, metric, by="child", only=asked)
    best = near.groupBy("point_id").agg(F.min(F.struct(F.round("dist", 9).alias("r"), "child")).alias("m"))
    return named.join(best, "point_id").select("path", "grid_id", "p", F.conv(F.substring("m.child", -1, 1), 36, 10).cast("long").alias("label"))


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0))
    return out


def _unpack(shapes: list[int], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    dim = shapes[0]
    centre, scale, at, layers = flat[:dim], flat[dim : 2 * dim], 2 * dim, []
    for m, n in zip(shapes[:-1], shapes[1:]):
        layers.append((flat[at : at + m * n].reshape(m, n), flat[at + m * n : at + m * n + n]))
        at += m * n + n
    return centre, scale, layers


def _train(x: np.ndarray, y: np.ndarray, classes: int, width: int, depth: int, epochs: int, rate: float, seed: int) -> tuple[list[int], np.ndarray, float, list[float]]:
    """Full-batch Adam on softmax cross-entropy; the best epoch's weights stay. The accuracy is
    recorded ten times on the way."""
    centre, scale = x.mean(0), x.std(0) + 1e-12
    z = (x - centre) / scale
    shapes = [x.shape[1], *[width] * depth, classes]
    rng = np.random.default_rng(seed)
    layers = [(rng.normal(0, np.sqrt(2 / m), (m, n)), np.zeros(n)) for m, n in zip(shapes[:-1], shapes[1:])]
    state = [[np.zeros_like(p) for _ in range(2)] for layer in layers for p in layer]
    target = np.eye(classes)[y]
    best, kept, history = np.inf, layers, []
    for epoch in range(1, epochs + 1):
        acts = _forward(z, layers)
        chance = np.exp(acts[-1] - acts[-1].max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        loss = -np.log(chance[np.arange(len(y)), y] + 1e-12).mean()
        if epoch % max(1, epochs // 10) == 0:
            history.append(float((acts[-1].argmax(1) == y).mean()))
        if loss < best:
            best, kept = loss, [(w.copy(), b.copy()) for w, b in layers]
        grad, grads = (chance - target) / len(y), []
        for i in range(len(layers) - 1, -1, -1):
            grads[:0] = [acts[i].T @ grad, grad.sum(0)]
            grad = (grad @ layers[i][0].T) * (acts[i] > 0)
        for p, g, s in zip([p for layer in layers for p in layer], grads, state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            p -= rate * (s[0] / (1 - 0.9**epoch)) / (np.sqrt(s[1] / (1 - 0.999**epoch)) + 1e-8)
    hit = float((_forward(z, kept)[-1].argmax(1) == y).mean())
    return shapes, np.concatenate([centre, scale, *(np.concatenate([w.ravel(), b]) for w, b in kept)]), hit, history


def fit_router(labelled: DataFrame, width: int = 300, depth: int = 5, epochs: int = 2000, rate: float = 0.001, seed: int = 0) -> DataFrame:
    """(path, shapes, weights, accuracy, history) per node from (path, grid_id, p, label, children).

    accuracy is that of the weights that stay, history that of the training points over the epochs."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("grid_id")
        x = np.array(rows.p.tolist(), dtype=float)
        shapes, weights, hit, history = _train(x, rows.label.to_numpy(int), int(rows.children.iloc[0]), width, depth, epochs, rate, seed)
        return pd.DataFrame({"path": [key[0]], "shapes": [shapes], "weights": [weights.tolist()], "accuracy": [hit], "history": [history]})

    return labelled.groupBy("path").applyInPandas(fit, _ROUTER)


@dataclass
class Node:
    centroids: np.ndarray
    router: tuple | None

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Router scores; a node without one scores by the nearest centroid (Chebyshev)."""
        if self.router is None:
            return -np.abs(x[:, None, :] - self.centroids[None]).max(2)
        centre, scale, layers = self.router
        return _forward((x - centre) / scale, layers)[-1]


class Parts:
    """The inner nodes of a tree in parts of bounded bytes: the upper levels that fit together, then each level
    by the hash of the path. Only sizes by level reach the driver; a part is collected when its pass runs."""

    def __init__(self, inner: DataFrame, routers: DataFrame | None, max_bytes: int):
        self.inner, self.routers = inner, routers
        self.levels: list[list] = []
        sizes = {r.depth: r.bytes for r in inner.groupBy("depth").agg(F.sum("bytes").alias("bytes")).collect()}  # one row a level
        self.place: dict[int, int] = {}
        upper = [depth for depth in sorted(sizes) if sum(v for d, v in sizes.items() if d <= depth) <= max_bytes]
        if upper:
            self.levels.append([F.col("depth") <= upper[-1]])
            self.place |= dict.fromkeys(upper, 0)
        for depth in sorted(sizes.keys() - set(upper)):
            parts = -(-sizes[depth] // max_bytes)
            self.place[depth] = len(self.levels)
            self.levels.append([(F.col("depth") == depth) & (F.pmod(F.xxhash64("path"), F.lit(parts)) == i) for i in range(parts)])

    @property
    def whole(self) -> bool:
        return sum(map(len, self.levels)) <= 1

    def of_depth(self, depth: int) -> list:
        """Conditions of the parts that make one level."""
        return [(F.col("depth") == depth) & part for part in self.levels[self.place[depth]]]

    def tables(self) -> Iterator[dict[str, Node]]:
        for level in self.levels:
            for part in level:
                yield self.table(part)

    def table(self, part=None) -> dict[str, Node]:
        inner = self.inner if part is None else self.inner.where(part)
        return _shipped(inner.select("path", "centroids"), self.routers)


Tree = dict[str, "Node"] | Parts


def inner_nodes(nodes: DataFrame, routers: DataFrame | None, max_bytes: int = MAX_BYTES) -> Tree:
    """Routing table of a tree's inner nodes: one dictionary if it fits ``max_bytes``, else ``Parts``."""
    inner = nodes.where("!is_leaf").select("path", "depth", "centroids")
    numbers = F.size(F.flatten("centroids"))
    if routers is not None:
        inner = inner.join(routers.select("path", F.size("weights").alias("own")), "path", "left")
        numbers = numbers + F.coalesce("own", F.lit(0))
    parts = Parts(materialize(inner.select("path", "depth", "centroids", (numbers * 8 + _NODE_BYTES).cast("long").alias("bytes")), "inner"), routers, max_bytes)
    return parts.table() if parts.whole else parts


def _shipped(inner: DataFrame, routers: DataFrame | None) -> dict[str, Node]:
    rows = inner.join(routers.drop("accuracy", "history"), "path", "left") if routers is not None else inner.withColumn("shapes", F.lit(None)).withColumn("weights", F.lit(None))
    return {r.path: Node(np.array(r.centroids, dtype=float), _unpack(list(r.shapes), np.array(r.weights)) if r.shapes else None) for r in rows.collect()}


def _axes(dim: int) -> list[str]:
    """Columns of a point: x, y, z, or one array p in more dimensions."""
    return ["x", "y", "z"][:dim] if dim <= 3 else ["p"]


def _types(dim: int) -> str:
    return ", ".join(f"{a} double" for a in _axes(dim)) if dim <= 3 else "p array<double>"


def _coordinates(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    if dim <= 3:
        return pdf[_axes(dim)].to_numpy(dtype=float)
    return np.array([np.full(dim, np.nan) if v is None else v for v in pdf.p], dtype=float).reshape(-1, dim)


def route_greedy(points: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """(point_id, x, y[, z] or p, visited array<string>): the nodes below the root on the way to a leaf.

    Works on a streaming DataFrame as well, for rows don't depend on each other, if the tree is one table."""
    rows = points.withColumn("visited", F.array().cast("array<string>"))
    if isinstance(tree, dict):
        return _walk(rows, tree, dim)
    for table in tree.tables():
        rows = materialize(_walk(rows, table, dim), "walk")
    return rows


def _walk(points: DataFrame, tree: dict[str, Node], dim: int) -> DataFrame:
    """Points go on from the last node they have visited as far as the table knows the way."""
    axes = _axes(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _coordinates(pdf, dim)
            seen = [list(v) for v in pdf.visited]
            at = np.array([v[-1] if v else "0" for v in seen], dtype=object)
            while True:
                moved = False
                for path in sorted(set(at.tolist()) & tree.keys()):
                    rows = np.flatnonzero(at == path)
                    for i, z in zip(rows, tree[path].logits(x[rows]).argmax(1)):
                        at[i] = path + DIGITS[z]
                        seen[i].append(at[i])
                    moved = True
                if not moved:
                    break
            yield pdf[["point_id", *axes]].assign(visited=seen)

    return points.select("point_id", *axes, "visited").mapInPandas(run, f"point_id long, {_types(dim)}, visited array<string>")


def score_router(points: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """(point_id, path, child, best): each node's choice and its score, for all inner nodes. The points are a
    query set: the result has a row for each point and node."""
    axes = _axes(dim)
    if isinstance(tree, Parts):
        return reduce(DataFrame.union, [materialize(score_router(points, table, dim), "scores") for table in tree.tables()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _coordinates(pdf, dim)
            for path, node in sorted(tree.items()):
                scores = node.logits(x)
                yield pd.DataFrame({"point_id": pdf.point_id, "path": path, "child": scores.argmax(1).astype(np.int64), "best": scores.max(1)})

    return points.select("point_id", *axes).mapInPandas(run, "point_id long, path string, child long, best double")


def _children(tree: dict[str, Node], path: str) -> list[str]:
    node = tree[path]
    return [path + DIGITS[z] for z in range(len(node.centroids) if node.router is None else node.router[2][-1][0].shape[1])]


def _expanded(rows: DataFrame, table: dict[str, Node], dim: int, columns: str, grow: Callable[[pd.DataFrame, np.ndarray], dict]) -> DataFrame:
    """Rows (point_id, axes, path, ...) at nodes of a table, one for each child; ``grow`` gives the other columns."""
    axes = _axes(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, own in pdf.groupby("path"):
                if path in table:
                    scores = table[path].logits(_coordinates(own, dim))
                    for z, child in enumerate(_children(table, path)):
                        yield own[["point_id", *axes]].assign(path=child, **grow(own, scores[:, z]))

    return rows.mapInPandas(run, f"point_id long, {_types(dim)}, path string, {columns}")


def _in_parts(rows: DataFrame, tree: Parts, dim: int, columns: str, grow: Callable[[pd.DataFrame, np.ndarray], dict], keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rows at the root grown to the leaves, level by level, for a tree that is not shipped whole."""
    inner = tree.inner.select("path", "depth")
    first = min(r.depth for r in inner.select("depth").distinct().collect())
    done = None
    for depth in range(first, inner.agg(F.max("depth")).first()[0] + 1):
        here = inner.where(F.col("depth") == depth).select("path")
        at_leaf = rows.join(here, "path", "left_anti").select(rows.columns)
        done = at_leaf if done is None else done.unionByName(at_leaf)
        grown = [materialize(_expanded(rows, tree.table(part), dim, columns, grow), "grown") for part in tree.of_depth(depth)]
        rows = materialize(keep(reduce(DataFrame.union, grown)), "layer")
    return rows if done is None else done.unionByName(rows)


def route_by_sums(points: DataFrame, tree: Tree, dim: int, running: bool = False) -> DataFrame:
    """(point_id, x, y[, z] or p, path, score): the leaf with the largest sum of scores on its path, or
    with ``running`` the largest sum of running sums; of equal ones the first.

    The best way down from a node follows from those of its children. A score counts in each running
    sum from its node to the leaf, so ``running`` keeps the best way for each number of steps left. A batch
    holds the ways of the nodes on one path and of their children, never a column for each leaf. A tree
    in parts is summed leaf by leaf, in rows."""
    axes = _axes(dim)
    if isinstance(tree, Parts):
        best = leaf_sums(points, tree, dim, running).groupBy("point_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "score")).alias("m"))
        return points.select("point_id", *axes).join(best, "point_id").select("point_id", *axes, "m.path", "m.score")

    def ways(x: np.ndarray, path: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Steps left to a leaf (0 for any number unless ``running``): best score and leaf of each point."""
        if path not in tree:
            return {0: (np.zeros(len(x)), np.full(len(x), path, dtype=object))}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        scores = tree[path].logits(x)
        for z, child in enumerate(_children(tree, path)):
            for left, (score, leaf) in ways(x, child).items():
                steps = left + 1 if running else 0
                own = scores[:, z] * (steps if running else 1) + score
                if steps not in best:
                    best[steps] = own, leaf
                else:
                    more = own > best[steps][0]
                    best[steps] = np.where(more, own, best[steps][0]), np.where(more, leaf, best[steps][1])
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(ways(_coordinates(pdf, dim), "0").values())
            score, leaf = found[0]
            for other, path in found[1:]:
                more = (other > score) | ((other == score) & (path < leaf))
                score, leaf = np.where(more, other, score), np.where(more, path, leaf)
            yield pdf[["point_id", *axes]].assign(path=leaf, score=score)

    return points.select("point_id", *axes).mapInPandas(run, f"point_id long, {_types(dim)}, path string, score double")


def leaf_sums(points: DataFrame, tree: Tree, dim: int, running: bool = False) -> DataFrame:
    """(point_id, path, score) for every leaf: the sum of the scores on its path, or with ``running``
    the sum of the running sums. The points are a query set; a batch holds the sums of one path at a time."""
    if isinstance(tree, Parts):
        start = points.select("point_id", *_axes(dim), F.lit("0").alias("path"), F.lit(0.0).alias("own"), F.lit(0.0).alias("total"))
        grown = _in_parts(start, tree, dim, "own double, total double", lambda rows, s: {"own": rows["own"] + s, "total": rows["total"] + rows["own"] + s})
        return grown.select("point_id", "path", F.col("total" if running else "own").alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _coordinates(pdf, dim)
            waiting = [("0", np.zeros(len(x)), np.zeros(len(x)))]
            while waiting:
                path, own, total = waiting.pop()
                if path not in tree:
                    yield pd.DataFrame({"point_id": pdf.point_id, "path": path, "score": total if running else own})
                    continue
                scores = tree[path].logits(x)
                waiting += [(child, own + scores[:, z], total + own + scores[:, z]) for z, child in enumerate(_children(tree, path))]

    return points.select("point_id", *_axes(dim)).mapInPandas(run, "point_id long, path string, score double")


def route_beam(points: DataFrame, tree: Tree, dim: int, k: int, eps: float) -> DataFrame:
    """(point_id, path): leaves reached when each layer keeps up to k nodes whose score is within
    eps of the layer's best for that point."""
    axes = _axes(dim)
    if isinstance(tree, Parts):
        own = Window.partitionBy("point_id")

        def keep(rows: DataFrame) -> DataFrame:
            ranked = rows.withColumn("rank_", F.row_number().over(own.orderBy(F.desc("score"), "path"))).withColumn("best_", F.max("score").over(own))
            return ranked.where((F.col("rank_") <= k) & (F.col("best_") - F.col("score") <= eps)).select(rows.columns)

        start = points.select("point_id", *axes, F.lit("0").alias("path"), F.lit(0.0).alias("score"))
        return _in_parts(start, tree, dim, "score double", lambda rows, s: {"score": s}, keep).select("point_id", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _coordinates(pdf, dim)
            layer = [(i, "0", 0.0) for i in range(len(pdf))]
            out = []
            while layer:
                grown: dict[int, list[tuple[float, str]]] = {}
                by_node: dict[str, list[tuple[int, float]]] = {}
                for i, path, score in layer:
                    if path in tree:
                        by_node.setdefault(path, []).append((i, score))
                    else:
                        out.append((i, path))
                for path, rows in by_node.items():
                    scores = tree[path].logits(x[[i for i, _ in rows]])
                    for (i, _), own in zip(rows, scores):
                        grown.setdefault(i, []).extend((-float(s), path + DIGITS[z]) for z, s in enumerate(own))
                layer = []
                for i, options in grown.items():
                    options.sort()
                    layer += [(i, path, -s) for s, path in options[:k] if s - options[0][0] <= eps]
            yield pd.DataFrame({"point_id": pdf.point_id.to_numpy()[[i for i, _ in out]] if out else [], "path": [p for _, p in out]}).astype({"point_id": "int64", "path": "object"})

    return points.select("point_id", *axes).mapInPandas(run, "point_id long, path string")


def upwards(rows: DataFrame) -> DataFrame:
    """Rows with a path, once for every node on it from the root, as ``node``."""
    return rows.withColumn("node", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))))


def prefixes(assign: DataFrame, metric: Metric) -> DataFrame:
    """Objects once for every node below the root that holds them, and for the root, as ``node``."""
    return upwards(assign.select("object_id", *metric.columns, "path")).drop("path")


def query_leaf(routed: DataFrame, assign: DataFrame, metric: Metric) -> DataFrame:
    """(point_id, path, object_id, dist): the nearest object within the named leaf (or leaves)."""
    axes = list(metric.axes)
    spots = routed.select("point_id", *axes).distinct()
    return nearest_neighbor(assign, spots, metric, by="path", only=routed.select("point_id", "path").distinct())


def query_tree(points: DataFrame, tree: Tree, assign: DataFrame, metric: Metric) -> DataFrame:
    """The nearest object within the leaf that greedy routing reaches."""
    routes = route_greedy(points, tree, metric.dim)
    return query_leaf(routes.withColumn("path", F.coalesce(F.try_element_at("visited", F.lit(-1)), F.lit("0"))), assign, metric)


def query_tree_verbose(points: DataFrame, tree: Tree, assign: DataFrame, metric: Metric) -> DataFrame:
    """(point_id, layer, node, object_id, dist): the nearest object in each node below the root that
    greedy routing visits."""
    axes = list(metric.axes)
    visits = route_greedy(points, tree, metric.dim).select("point_id", F.explode("visited").alias("node"))
    near = nearest_neighbor(prefixes(assign, metric), points.select("point_id", *axes), metric, by="node", only=visits)
    return near.select("point_id", (F.length("node") - 1).cast("long").alias("layer"), "node", "object_id", "dist")
