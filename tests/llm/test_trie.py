"""Prefix trie and its centroid decomposition against a direct computation."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from orbitree.llm.trie import _local_sums, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    whole = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + own[c][zlib.crc32(str(c).encode()) % 6 :] for c in own}
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        saved[path] = saved.get(path, 0) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            leaves[path[:-1]] = leaves.get(path[:-1], 0) + leaves[path]
            saved[path[:-1]] = saved.get(path[:-1], 0) + saved[path]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items()]


def _same(spark, rows, **kwargs):
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA), **kwargs)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, _brute(rows)))


def _chats(draw, n):
    rows = []
    for c in draw.sample(range(400), n):
        for t in range(draw.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {draw.randrange(3)} ü" * draw.randrange(1, 3)))
    return rows


@pytest.mark.parametrize("local_nodes", [20_000, 9])
def test_trie_equals_direct_computation(spark, local_nodes):
    _same(spark, _chats(random.Random(local_nodes), 60), local_nodes=local_nodes)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 1, "user", "b"), (0, 1, "user", "a"), (1, 5, "x", "y"), (2, None, "x", "y"), (2, None, "x", "y"), (None, 1, "x", "y"), (250, 0, "x", "y"), (251, 0, "x", None), (100, 0, "user", "long" * 300_000)]
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(3)]
    _same(spark, rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(*r, "n", 1) for r in rows[:6]], SCHEMA + ", node string, size long")
    assert sorted(map(str, (tuple(r) for r in prefix_trie(extra).collect()))) == sorted(map(str, _brute(rows[:6])))


def test_one_deep_conversation(spark):
    rows = [(7, t, "user", "a") for t in range(300)] + [(8, t, "user", "a" if t < 200 else "b") for t in range(220)]
    _same(spark, rows, local_nodes=60)


def test_local_sums_of_a_long_chain_and_a_star():
    n = 3000
    chain = pd.DataFrame({"node": [f"n{i}" for i in range(n)], "parent": [None, *(f"n{i}" for i in range(n - 1))], "depth": range(n), "size": range(n, 0, -1), "w": [np.array([1])] * n, "a": [np.array([0])] * n})
    star = pd.DataFrame({"node": [f"s{i}" for i in range(n)], "parent": [None] + ["s0"] * (n - 1), "depth": [5] + [6] * (n - 1), "size": [n] + [1] * (n - 1), "w": [np.array([1])] * n, "a": [np.array([0])] * n})
    both = pd.concat([chain, star]).sample(frac=1, random_state=1)
    got = {r.node: r.a[0] for r in _local_sums(both).itertuples()}
    assert got == {f"n{i}": n - i for i in range(n)} | {f"s{i}": n if i == 0 else 1 for i in range(n)}
