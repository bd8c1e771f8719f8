"""Conversation prefix trie (operator 11): centroid decomposition of the parent-edge forest.

A node is a distinct sequence of first turns, named by a rolling hash. Its owner is the smallest
conversation that starts with it; a conversation owns the nodes of its path from some depth on, and
such a stretch of nodes is one row of the decomposition, a *segment*. Sums over subtrees come from
splitting components (connected parts of the trie) at centroids, all components at once:

* the nodes of a component whose subtree in it holds at least half of it form a path from the
  top down; the last one is the centroid, as the sizes fall strictly along the path;
* what lies below and at the centroid is summed (the component's total) and added to all nodes of that path;
* the path's sizes shrink by the centroid's, and the component falls apart into the part above and the parts
  below each child; the centroid is finished.

Sizes halve, so there are log2 rounds over the nodes. Components up to a bound of nodes go on with
the same recursion inside tasks, many of them in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitree.llm.merkle import crc32_sql
from orbitree.llm.shared import materialize

#: Nodes of components that one task goes on with.
LOCAL_NODES = 20_000
#: Children from which a node's row is broadcast to them rather than shuffled.
HOT_CHILDREN = 10_000
ROOT = md5(b"").hexdigest()
NO_IDS = sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, lens): rebuilt conversations; of each turn a digest of role and text, and the text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    digest = lambda t: F.struct(F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary")).alias("key"), F.length(t["text"]).cast("long").alias("len"))
    own = materialize(rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), digest).alias("own")), "turns")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 5).alias("head"))
    at = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    joined = own.withColumn("h", at.cast("int")).withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left")
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<key:string,len:bigint>>")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("conv_id", whole.alias("t")).select("conv_id", "t.key", "t.len").toDF("conv_id", "keys", "lens")


def _prefixes(keys: pd.Series) -> pd.Series:
    """Rolling hashes of a conversation's prefixes, the empty one first."""

    def roll(turns) -> list[str]:
        out = [ROOT]
        for key in turns:
            out.append(md5((out[-1] + key).encode()).hexdigest())
        return out

    return keys.map(roll)


def trie_nodes(logs: DataFrame) -> DataFrame:
    """Nodes of logs (conv_id, path, lens): (node, parent, depth, owner, n_convs, len, n_children, size), size
    being the nodes of the subtree.

    A conversation's own nodes at or below a node are counted in every node of its path, so that sizes are one
    aggregate; no node meets its descendants."""
    rows = logs.select("conv_id", "path", "lens", F.posexplode("path").alias("depth", "node"))
    parent, last = F.expr("get(path, depth - 1)"), F.expr("get(lens, depth - 1)")
    bare = materialize(rows.select("conv_id", "depth", "node", parent.alias("parent"), last.alias("len")).groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.coalesce(F.min("len"), F.lit(0)).alias("len")), "nodes")
    spans = bare.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    owned = logs.join(spans, "conv_id").select("lo", "hi", F.posexplode(F.slice("path", F.lit(1), F.col("hi") + 1)).alias("depth", "node"))
    sizes = owned.groupBy("node").agg(F.sum(F.col("hi") - F.greatest("depth", "lo") + 1).alias("size"))
    children = bare.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return materialize(bare.join(sizes, "node").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def _segments(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """One row for the nodes of each owner: (top, top_depth, path of the ancestors from the top on, lo, nodes)."""
    zero = F.array(*(F.lit(0).cast("long") for _ in values))
    entry = F.struct("depth", "node", "size", F.array(*(F.col(v).cast("long") for v in values)).alias("w"), zero.alias("a"))
    own = nodes.groupBy("owner").agg(F.min("depth").alias("lo"), F.sort_array(F.collect_list(entry)).alias("nodes"))
    strip = F.transform("nodes", lambda x: F.struct(x["node"].alias("node"), x["size"].alias("size"), x["w"].alias("w"), x["a"].alias("a")))
    return own.join(paths.withColumnRenamed("conv_id", "owner"), "owner").select(F.get("path", F.lit(0)).alias("top"), F.lit(0).alias("top_depth"), F.slice("path", F.lit(1), F.col("lo")).alias("path"), "lo", strip.alias("nodes"))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _round(segments: DataFrame, big: DataFrame, n_values: int) -> DataFrame:
    """One split of all components in ``big`` (top, n): their segments as (done, top, top_depth, path, lo, nodes);
    finished centroids are rows of their own. Only rows of big components are given back; their number is
    bounded by nodes over ``local_nodes``, so the tables of components and centroids are small."""
    rows = segments.join(F.broadcast(big), "top")
    heavy = F.filter("nodes", lambda x: 2 * x["size"] >= F.col("n"))
    last = F.try_element_at(heavy, F.lit(-1))
    offers = rows.where(F.size(heavy) > 0).select("top", F.struct(last["size"].alias("size"), last["node"].alias("node"), (F.col("lo") + F.size(heavy) - 1).alias("depth")).alias("c"))
    centroids = offers.groupBy("top").agg(F.min("c").alias("c"))
    rows = rows.join(F.broadcast(centroids), "top")
    behind = F.col("c.depth") - F.col("lo")
    through = F.coalesce(F.when(behind < 0, F.get("path", F.col("c.depth") - F.col("top_depth")) == F.col("c.node")).otherwise(F.get("nodes", behind)["node"] == F.col("c.node")), F.lit(False))
    rows = materialize(rows.withColumn("through", through), "split")
    # what lies at and below the centroid; keep = nodes of the segment above it
    keep = F.when(F.col("through"), F.greatest(F.col("c.depth") - F.col("lo"), F.lit(0))).otherwise(F.size("nodes"))
    rows = rows.withColumn("keep", keep)
    zero = F.array(*(F.lit(0).cast("long") for _ in range(n_values)))
    below = F.aggregate(F.slice("nodes", F.col("keep") + 1, F.size("nodes")), zero, lambda acc, x: _add(acc, x["w"]))
    part = rows.where("through").select("top", below.alias("s")).groupBy("top").agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(n_values))).alias("total"))
    rows = rows.join(F.broadcast(part), "top")

    def entry(x: Column, size: Column, a: Column) -> Column:
        return F.struct(x["node"].alias("node"), size.alias("size"), x["w"].alias("w"), a.alias("a"))

    raised = F.transform(F.slice("nodes", F.lit(1), F.col("keep")), lambda x: F.when(2 * x["size"] >= F.col("n"), entry(x, x["size"] - F.col("c.size"), _add(x["a"], F.col("total")))).otherwise(x))
    upper = F.when(F.col("keep") > 0, F.struct(F.lit(False).alias("done"), F.col("top").alias("top"), F.col("top_depth").alias("top_depth"), F.col("path").alias("path"), F.col("lo").alias("lo"), raised.alias("nodes")))
    own = F.col("through") & (F.col("c.depth") >= F.col("lo"))
    middle = F.when(own, F.struct(F.lit(True).alias("done"), F.col("top").alias("top"), F.col("top_depth").alias("top_depth"), F.array().cast("array<string>").alias("path"), F.col("c.depth").alias("lo"), F.transform(F.slice("nodes", F.col("keep") + 1, F.lit(1)), lambda x: entry(x, x["size"], _add(x["a"], F.col("total")))).alias("nodes")))
    start = F.greatest(F.col("c.depth") + 1, F.col("lo"))
    rest = F.slice("nodes", start - F.col("lo") + 1, F.size("nodes"))
    ahead = F.slice("path", F.col("c.depth") + 2 - F.col("top_depth"), F.size("path"))
    top = F.coalesce(F.get(ahead, F.lit(0)), F.get(rest, F.lit(0))["node"])
    lower = F.when(F.col("through") & (F.size(rest) > 0), F.struct(F.lit(False).alias("done"), top.alias("top"), (F.col("c.depth") + 1).alias("top_depth"), ahead.alias("path"), start.alias("lo"), rest.alias("nodes")))
    return rows.select(F.explode(F.array_compact(F.array(upper, middle, lower))).alias("s")).select("s.*")


def _local_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """The recursion for whole components in one task: rows (node, parent, depth, size, w, a)."""
    rows = rows.sort_values("depth", kind="stable")
    names = pd.Index(rows["node"])
    parent = names.get_indexer(pd.Index(rows["parent"]))
    size = rows["size"].to_numpy().copy()
    weight = np.array(rows["w"].tolist(), dtype=np.int64)
    total = np.array(rows["a"].tolist(), dtype=np.int64)
    depth = rows["depth"].to_numpy()
    n = len(rows)
    levels = np.split(np.arange(n), np.flatnonzero(np.diff(depth)) + 1)
    label = np.arange(n)
    for level in levels:
        inner = level[parent[level] >= 0]
        label[inner] = label[parent[inner]]
    alive = np.ones(n, dtype=bool)
    while alive.any():
        count = np.bincount(label[alive], minlength=n)
        heavy = np.flatnonzero(alive & (2 * size >= count[label]))
        order = heavy[np.argsort(-size[heavy], kind="stable")]
        centroid = np.full(n, -1)
        centroid[label[order]] = order  # the smallest of a component comes last
        middle = np.zeros(n, dtype=bool)
        middle[centroid[centroid >= 0]] = True
        after = label.copy()
        below = middle.copy()
        for level in levels[1:]:
            up = parent[level]
            inside = (up >= 0) & alive[level] & alive[up] & below[up] & (label[up] == label[level])
            child = level[inside]
            below[child] = True
            over = parent[child]
            after[child] = np.where(middle[over], child, after[over])
        sums = np.zeros((n, weight.shape[1]), dtype=np.int64)
        np.add.at(sums, label[below], weight[below])
        total[heavy] += sums[label[heavy]]
        size[heavy] -= size[centroid[label[heavy]]]
        alive[middle] = False
        label = after
    return pd.DataFrame({"node": rows["node"].to_numpy(), "a": list(total)})


def centroid_sums(nodes: DataFrame, paths: DataFrame, values: list[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, *values): the sums of the value columns over the subtree of every node, top included.

    ``nodes`` has node, depth, owner, size and the values; ``paths`` (conv_id, path) names the nodes from the
    root to the end of each owner. Rounds over the segments split the components of more than
    ``local_nodes`` nodes; the others are dealt to tasks of about as many nodes."""
    segments = materialize(_segments(nodes, paths, values), "segments")
    done = []
    while True:
        parts = segments.groupBy("top").agg(F.sum(F.size("nodes")).alias("n"))
        big = materialize(parts.where(F.col("n") > local_nodes), "big")
        if big.isEmpty():
            break
        small = segments.join(F.broadcast(big), "top", "left_anti")
        split = materialize(_round(segments, big, len(values)), "split")
        done.append(split.where("done").select(F.get("nodes", F.lit(0)).alias("x")).select("x.node", "x.a"))
        segments = materialize(small.unionByName(split.where("not done").drop("done")), "segments")
    each = segments.select("top", "lo", "path", "nodes", F.posexplode("nodes").alias("i", "x"))
    up = F.when(F.col("i") > 0, F.get("nodes", F.col("i") - 1)["node"]).otherwise(F.element_at("path", F.when(F.size("path") > 0, -1)))
    tasks = max(1, nodes.count() // local_nodes)
    rows = each.select(F.pmod(F.xxhash64("top"), F.lit(tasks)).alias("task"), "x.node", up.alias("parent"), (F.col("lo") + F.col("i")).alias("depth"), "x.size", "x.w", "x.a")
    local = rows.groupBy("task").applyInPandas(_local_sums, "node string, a array<bigint>")
    sums = reduce(DataFrame.unionByName, done, local)
    return sums.select("node", *(F.get("a", F.lit(i)).alias(v) for i, v in enumerate(values)))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids of each node, from rows that come sorted by (node, conv_id); holds one batch."""
    now, state = None, None
    for batch in batches:
        nodes, digests = [], []
        ids = batch.column("conv_id").to_pylist()
        for node, conv_id in zip(batch.column("node").to_pylist(), ids):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    digests.append(state.hexdigest())
                now, state = node, sha256(str(conv_id).encode())
            else:
                state.update(f",{conv_id}".encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"node": [now], "ends_sha256": [state.hexdigest()]})


def prefix_trie(turns: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row
    for each distinct sequence of first turns of the rebuilt conversations.

    Turns are ordered by (turn, role, text), null turns first; null roles and texts are empty;
    repeated rows are turns of their own; rows with a null conv_id are left out; an empty table gives no
    rows; other columns are ignored. One conversation is one row, so memory grows with the longest. The ids
    that end at a node are streamed in order through one digest, however many they are."""
    logs = materialize(rebuilt(turns).select("conv_id", F.pandas_udf(_prefixes, "array<string>")("keys").alias("path"), "lens"), "logs")
    nodes = trie_nodes(logs)
    sums = centroid_sums(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("len")), logs.select("conv_id", "path"), ["n_leaves", "saved_tokens"], local_nodes)
    ends = logs.select(F.element_at("path", -1).alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_end_digests, "node string, ends_sha256 string")
    full = materialize(nodes.join(sums, "node").join(ends, "node", "left"), "full")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") > HOT_CHILDREN).drop("n_children")  # at most nodes / HOT_CHILDREN rows
    cold = parents.where(F.col("n_children") <= HOT_CHILDREN).drop("n_children")
    out = full.join(F.broadcast(hot), "parent").unionByName(full.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(cold, "parent", "left"))
    columns = [F.col(c).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(F.col("owner").alias("conv_id"), *columns, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


#: The same in SQL: prefixes are whole strings, subtree sums a join of each node's owner with all its prefixes.
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = base AND k <= h UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t USING (conv_id) WHERE k > h),
r AS (SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, role, text FROM parts),
p AS (SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS len FROM c UNION ALL
      SELECT conv_id, depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth), length(text) FROM r),
q AS (SELECT *, LAG(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = MAX(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT prefix, MIN(conv_id) AS conv_id, MIN(depth) AS depth, MIN(parent) AS parent, COUNT(*) AS n_convs, MIN(len) AS len, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM q GROUP BY prefix),
m AS (SELECT n.*, COALESCE(kids, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS prefix, COUNT(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent) USING (prefix)),
s AS (SELECT q.prefix, COUNT(*) FILTER (m.n_children = 0) AS n_leaves, SUM((m.n_convs - 1) * m.len) AS saved_tokens FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.prefix)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(m.ids, '')) AS ends_sha256
FROM m JOIN s USING (prefix) LEFT JOIN n o ON o.prefix = m.parent
"""
