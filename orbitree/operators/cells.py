"""Trees over boxes for the neighbour search: cuts that deal objects and points to tasks, and the search within a task.

``Forest`` holds cuts from a thin sample of the objects' centres, so it only shapes the tasks, and bounds that come from all
objects: of every node the number of its objects, the box around theirs and the box around their anchors. A metric is never less than
the Chebyshev distance to an object's box, and never more than the Euclidean distance to its anchor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Objects of a leaf within a task; points and pairs that are looked at together.
LEAF, POINTS, PAIRS = 8, 2048, 1_000_000
#: Neighbours up to which rows are not sorted.
FEW = 8
#: Sizes of objects that get trees of their own, at most.
MAX_CLASSES = 12


def classes(power: np.ndarray) -> np.ndarray:
    """Powers of 4 of the objects' widths, joined to 16 and so on if there are more than ``MAX_CLASSES``."""
    width = 1
    while len(np.unique(power // width)) > MAX_CLASSES:
        width *= 2
    return power // width


def _far(q: np.ndarray, p: np.ndarray, al: np.ndarray, ah: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The most that a metric can be between points q[:, p] and objects whose anchors lie in boxes at; an axis a row."""
    total: np.ndarray | float = 0.0
    for x, a, b in zip(q, al, ah):
        x = x[p]
        far = np.maximum(np.abs(x - a[at]), np.abs(x - b[at]))
        total = total + far * far
    return np.sqrt(total) * (1 + 1e-9) + 1e-9


def _least(q: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least that a metric can be between points q[:, p] and objects in boxes at."""
    out: np.ndarray | float = 0.0
    for x, a, b in zip(q, lo, hi):
        x = x[p]
        out = np.maximum(out, np.maximum(a[at] - x, x - b[at]))
    return out


class Forest:
    """Cut trees; a tree's root has the tree's number. Nodes with a child at 0 have none."""

    def __init__(self, samples: list[np.ndarray], leaves: list[int]):
        axis, cut, child = [-1] * len(samples), [0.0] * len(samples), [0] * len(samples)
        waiting = [(i, s, n) for i, (s, n) in enumerate(zip(samples, leaves))]
        while waiting:
            node, points, n = waiting.pop()
            spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
            if n < 2 or not spread.max() > 0:
                continue
            axis[node] = int(spread.argmax())
            values = points[:, axis[node]]
            at = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
            cut[node] = float(at if at < values.max() else values[values < at].max())
            behind = values > cut[node]
            child[node] = len(axis)
            axis += [-1, -1]
            cut += [0.0, 0.0]
            child += [0, 0]
            waiting += [(child[node], points[~behind], n // 2), (child[node] + 1, points[behind], n - n // 2)]
        self.axis, self.cut, self.child = np.array(axis), np.array(cut), np.array(child)
        self.roots = len(samples)

    def leaf(self, tree: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The leaf of each point in its tree."""
        node, open_ = tree.copy(), np.flatnonzero(self.child[tree] > 0)
        while len(open_):
            at = node[open_]
            node[open_] = self.child[at] + (q[open_, self.axis[at]] > self.cut[at])
            open_ = open_[self.child[node[open_]] > 0]
        return node

    def bound(self, node: np.ndarray, n: np.ndarray, boxes: np.ndarray, local: int, k: int) -> None:
        """Take the counts and boxes (lo, hi, anchors' lo, anchors' hi) of the leaves, and name the blocks: the first nodes on the
        way down with at most ``local`` objects, or leaves; a leaf with more is dealt to several tasks."""
        total, dim = len(self.axis), boxes.shape[2]
        self.n = np.zeros(total, dtype=np.int64)
        self.n[node] = n
        self.boxes = np.empty((4, total, dim))
        self.boxes[[0, 2]], self.boxes[[1, 3]] = np.inf, -np.inf
        self.boxes[:, node] = boxes
        levels = [np.arange(self.roots)]
        while len(levels[-1]):
            inner = levels[-1][self.child[levels[-1]] > 0]
            levels.append(np.concatenate([self.child[inner], self.child[inner] + 1]))
        for level in reversed(levels):
            inner = level[self.child[level] > 0]
            a, b = self.child[inner], self.child[inner] + 1
            self.n[inner] = self.n[a] + self.n[b]
            for i, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum)):
                self.boxes[i][inner] = f(self.boxes[i][a], self.boxes[i][b])
        self.block, self.sure = np.full(total, -1), np.full(total, -1)
        first: list[np.ndarray] = []
        for level in levels:
            self.sure[level] = np.where(self.n[level] >= k, level, self.sure[level])
            new = level[(self.block[level] < 0) & ((self.n[level] <= local) | (self.child[level] == 0))]
            self.block[new] = new
            first.append(new)
            inner = level[self.child[level] > 0]
            for side in (0, 1):
                self.block[self.child[inner] + side] = self.block[inner]
                self.sure[self.child[inner] + side] = self.sure[inner]
        blocks = np.concatenate(first)
        parts = np.maximum(1, -(-self.n[blocks] // local))
        self.task, self.parts = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        self.task[blocks], self.parts[blocks] = np.cumsum(parts) - parts, parts
        self.tasks = int(parts.sum())

    def deal(self, tree: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The task of each object."""
        block = self.block[self.leaf(tree, q)]
        return self.task[block] + ids % self.parts[block]

    def visit(self, trees: list[np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, task) for all tasks with objects that can be near, and what the k-th distance of each point is at most.
        trees: the trees that a point asks, -1 for none."""
        reach, everyone = np.full(len(q), np.inf), np.arange(len(q))
        lo, hi, al, ah = (np.ascontiguousarray(v.T) for v in self.boxes)
        of = np.ascontiguousarray(q.T)
        for tree in trees:
            at = everyone[tree >= 0]
            sure = self.sure[self.leaf(tree[at], q[at])]
            at, sure = at[sure >= 0], sure[sure >= 0]
            reach[at] = np.minimum(reach[at], _far(of, at, al, ah, sure))
        found = []
        for tree in trees:
            point = everyone[tree >= 0]
            node = tree[point]
            while len(node):
                near = _least(of, point, lo, hi, node) <= reach[point]
                point, node = point[near], node[near]
                done = self.block[node] == node
                found.append((point[done], node[done]))
                point, node = np.repeat(point[~done], 2), np.repeat(self.child[node[~done]], 2)
                node[1::2] += 1
        point, node = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        parts = self.parts[node]
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(point, parts), np.repeat(self.task[node], parts) + part, reach


class LocalTree:
    """Objects of a task, halved across the longest side until a node has at most ``LEAF``; those of one size apart."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray):
        n, centre = len(lo), (lo + hi) / 2
        wide = (hi - lo).max(1)
        power = np.full(n, -10_000)
        power[wide > 0] = np.floor(np.log2(wide[wide > 0]) / 2)
        power = classes(power)
        self.order = np.argsort(power, kind="stable")
        starts = np.flatnonzero(np.diff(power[self.order], prepend=power[self.order[0]] - 1))
        ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(starts):
            ends = ranges_end(starts, n) if not ranges else ends
            split = ends - starts > LEAF
            child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
            ranges.append((starts, ends, child))
            s, e = starts[split], ends[split]
            if not len(s):
                break
            size = e - s
            seg = np.repeat(np.arange(len(s)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
            points, first = centre[self.order[at]], np.cumsum(size) - size
            spread = np.maximum.reduceat(points, first) - np.minimum.reduceat(points, first)
            value = points[np.arange(len(points)), spread.argmax(1)[seg]]
            self.order[at] = self.order[at[np.lexsort((value, seg))]]
            middle = s + (size + 1) // 2
            starts, ends = np.column_stack([s, middle]).ravel(), np.column_stack([middle, e]).ravel()
        self.lo, self.hi, self.anchor = (np.ascontiguousarray(v[self.order].T) for v in (lo, hi, anchor))
        self.levels = []
        for s, e, child in ranges:
            cover = lambda f, v: np.ascontiguousarray(f.reduceat(np.concatenate([v, v[:, -1:]], axis=1), np.column_stack([s, e]).ravel(), axis=1)[:, ::2])  # noqa: B023, E731
            self.levels.append((s, e, child, cover(np.minimum, self.lo), cover(np.maximum, self.hi), cover(np.minimum, self.anchor), cover(np.maximum, self.anchor)))

    def home(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, start, end): one node of few objects beside each point, of at least k if there are as many."""
        point = np.arange(q.shape[1])
        roots = self.levels[0]
        node = np.zeros(len(point), dtype=np.int64) + int(np.argmax(roots[1] - roots[0]))
        found = []
        for level, (starts, ends, child, *_) in enumerate(self.levels):
            stop = (child[node] < 0) | ((ends[node] - starts[node]) // 2 < k)
            found.append((point[stop], starts[node[stop]], ends[node[stop]]))
            point, node = point[~stop], child[node[~stop]]
            if not len(point):
                break
            _, _, _, lo, hi, _, _ = self.levels[level + 1]
            gap: list[np.ndarray | float] = [0.0, 0.0]
            for x, a, b in zip(q, lo, hi):
                for side in (0, 1):
                    gap[side] = np.maximum(gap[side], np.abs(x[point] - (a[node + side] + b[node + side]) / 2))
            node = node + (gap[1] < gap[0])
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def near(self, q: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, start, end): leaves that can hold one of a point's k nearest; reach is lowered on the way."""
        roots = len(self.levels[0][0])
        point, node = np.repeat(np.arange(q.shape[1]), roots), np.tile(np.arange(roots), q.shape[1])
        found = []
        for starts, ends, child, lo, hi, al, ah in self.levels:
            least = _least(q, point, lo, hi, node)
            keep = least <= reach[point]
            point, node, least = point[keep], node[keep], least[keep]
            unknown = np.flatnonzero(np.isinf(reach[point]) & (ends[node] - starts[node] >= k))
            if len(unknown):
                np.minimum.at(reach, point[unknown], _far(q, point[unknown], al, ah, node[unknown]))
                keep = least <= reach[point]
                point, node, least = point[keep], node[keep], least[keep]
            leaf = child[node] < 0
            found.append((point[leaf], starts[node[leaf]], ends[node[leaf]], least[leaf]))
            point, node = np.repeat(point[~leaf], 2), np.repeat(child[node[~leaf]], 2)
            node[1::2] += 1
        point, start, end, least = (np.concatenate([f[i] for f in found]) for i in range(4))
        keep = least <= reach[point]
        return point[keep], start[keep], end[keep]


def ranges_end(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def contenders(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, ids: np.ndarray, shape: np.ndarray | None, pairs: Callable | None, q: np.ndarray, reach: np.ndarray, k: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(object, point) of all pairs that can be among a point's k nearest by (distance rounded to 9 digits, id), or with ``last``
    the larger id. With the metric's ``pairs`` its distances decide, up to what rounding leaves open; without, the bounds."""
    tree = LocalTree(lo, hi, anchor)
    order, rank = tree.order, (-ids if last else ids)
    shape = shape[order] if pairs is not None else None
    rank = rank[order]
    out = []
    for begin in range(0, len(q), POINTS):
        rows = q[begin : begin + POINTS]
        own, far = np.ascontiguousarray(rows.T), reach[begin : begin + POINTS].copy()
        # what lies beside a point bounds its k-th distance
        p, o = _spread(*tree.home(own, k))
        most = _far(own, p, tree.anchor, tree.anchor, o) if pairs is None else pairs(shape[o], rows[p])
        most = np.where(np.isnan(most), np.inf, most)
        sort = np.lexsort((most, p))
        p, most = p[sort], most[sort]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        enough = np.diff(np.append(first, len(p))) >= k
        at = p[first[enough]]
        far[at] = np.minimum(far[at], most[first[enough] + k - 1] * (1 + 1e-9) + 2e-9)
        point, start, end = tree.near(own, far, k)
        sort = np.argsort(point, kind="stable")
        point, start, end = point[sort], start[sort], end[sort]
        total = np.cumsum(end - start)
        at = 0
        while at < len(point):
            upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right"))
            if upto < len(point):
                whole = int(np.searchsorted(point, point[upto], side="left"))
                upto = whole if whole > at else int(np.searchsorted(point, point[upto], side="right"))
            p, o = _spread(point[at:upto], start[at:upto], end[at:upto])
            at = upto
            least = _least(own, p, tree.lo, tree.hi, o)
            keep = least <= far[p]
            p, o, least = p[keep], o[keep], least[keep]
            if pairs is None:
                most = _far(own, p, tree.anchor, tree.anchor, o)
            else:
                dist = pairs(shape[o], rows[p])
                known = np.flatnonzero(dist <= far[p])
                p, o, dist = p[known], o[known], dist[known]
                eps = 1e-12 * (1 + np.abs(rows).max(1)[p] + dist)
                least, most = np.rint((dist - eps) * 1e9), np.rint((dist + eps) * 1e9)
            keep = _among(p, least, most, rank[o] if pairs is not None else None, k)
            out.append((order[o[keep]], p[keep] + begin))
    return tuple(np.concatenate([f[i] for f in out]) if out else np.zeros(0, dtype=np.int64) for i in (0, 1))


def _spread(point: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point with each object of its ranges."""
    size = end - start
    return np.repeat(point, size), np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _among(p: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray | None, k: int) -> np.ndarray:
    """Pairs, in order of p, that fewer than k others of their point surely come before."""
    if not len(p):
        return np.zeros(0, dtype=bool)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    group = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
    if k == 1:
        bound = np.minimum.reduceat(most, first)[group]
        if rank is None:
            return least <= bound
        ends = np.minimum.reduceat(np.where(most == bound, rank, np.iinfo(np.int64).max), first)[group]
        return (least < bound) | ((least == bound) & (rank <= ends))
    if rank is None:
        rank = np.zeros(len(p), dtype=np.int64)
    if k <= FEW:
        left, size = most.copy(), np.diff(np.append(first, len(p)))
        enough = (size >= k)[group]
        for turn in range(k):
            bound = np.minimum.reduceat(left, first)[group]
            ends = np.minimum.reduceat(np.where(left == bound, rank, np.iinfo(np.int64).max), first)[group]
            if turn < k - 1:  # take out one; of alike ranks all are kept by the last turn
                gone = np.flatnonzero((left == bound) & (rank == ends))
                left[gone[np.flatnonzero(np.diff(group[gone], prepend=-1))]] = np.inf
        return ~enough | (least < bound) | ((least == bound) & (rank <= ends))
    sort = np.lexsort((rank, most, p))
    size = np.diff(np.append(first, len(p)))
    kth = sort[first + np.minimum(size, k) - 1]
    enough, bound = (size >= k)[group], most[kth][group]
    return ~enough | (least < bound) | ((least == bound) & (rank <= rank[kth][group]))
