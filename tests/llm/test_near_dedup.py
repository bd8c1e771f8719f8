from __future__ import annotations

import random

from pyspark.sql import functions as F

from orbitree.llm.near_dedup import drop_near_duplicates, near_duplicates


def _sets(text, k=5):
    words = [w for w in (text or "").lower().split() if w]
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def brute(rows, threshold):
    sets = {i: _sets(t) for i, t in rows}
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both) and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return {i: (len(sets[i]), part[i]) for i in sets}


def _corpus():
    draw = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = [draw.choice(vocab) for _ in range(150)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9, 12, 20):
            words = list(base)
            for _ in range(edits):
                words[draw.randrange(150)] = draw.choice(vocab) + "x"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, " \n\t")]
    return rows


def test_components_equal_brute_force(spark):
    rows = _corpus()
    for threshold in (80, 85):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, threshold=threshold).collect()}
        assert got == brute(rows, threshold)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, None, "z"), (2, "a b c d e f", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string")
    one, many = (near_duplicates(docs.repartition(n)).orderBy(F.col("doc_id")).collect() for n in (1, 9))
    assert one == many


def test_rows_that_share_an_id(spark):
    draw = random.Random(9)
    text = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    one, other, third = text(200), text(200), text(200)
    rows = [(1, " ".join(one), "a"), (1, " ".join(other), "b"), (2, " ".join([*one[:-1], "x"]), "c"), (3, " ".join([*other[:-1], "y"]), "d"), (3, " ".join(third), "e"), (3, " ".join(third), "f"), (None, " ".join(one), "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("3", "3", True), ("3", "3", True), ("None", "None", True)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    names = sorted(r.name for r in kept.collect())
    assert names[:2] == ["a", "b"] and len(names) == 4 and names[2] in "ef" and names[3] == "g"
