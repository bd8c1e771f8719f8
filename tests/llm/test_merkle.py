"""Merkle manifest against a direct computation."""

from __future__ import annotations

import hashlib
import random
import zlib

from orbitree.llm.merkle import fold_up, manifest
from orbitree.llm.shared import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _path(levels, i):
    for level in levels[:-1]:
        lo = i // 8 * 8
        yield "".join(level[lo:i]), "".join(level[i + 1 : lo + 8])
        i //= 8


def _brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for lang in order:
        docs = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees.append((docs, _levels([_leaf(*r) for r in docs])))
    top = _levels([levels[-1][0] for _, levels in trees])
    out = []
    for t, (docs, levels) in enumerate(trees):
        for i, row in enumerate(docs):
            path = [*_path(levels, i), *_path(top, t)]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = _leaf(row[0], text, *row[2:])
            for left, right in path:
                acc = _h(left + acc + right)
            out.append((row[0], levels[0][i], levels[-1][0], top[-1][0], _h("".join(a + b for a, b in path)), acc, acc == top[-1][0]))
    return out


def _check(spark, rows):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _brute(rows)))
    return got


def test_manifest_equals_direct_computation(spark):
    draw = random.Random(30)
    rows = [(i, draw.choice(["Text A", "plain", "ÄÖ Mixed", ""]) * draw.randrange(3), draw.choice(["en"] * 8 + ["de", "fr"]), draw.choice(["a", "b", None]), draw.choice([None, 3])) for i in range(230)]
    rows += [(1000 + i, "One", f"l{i}", "s", 1) for i in range(9)]
    got = _check(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "A", None, "s", 1)] * 20 + [(5, "B", None, "s", 1), (5, "B", "", "s", 1), (6, "Z" * 300_000, "é", "s", 1), (-3, "Q", "z", "", 0)]
    _check(spark, rows)
    _check(spark, [(3, "X", "en", "s", 1)])
    _check(spark, [(i, "X", None, "s", 1) for i in range(9)])


def test_empty_and_extra_columns(spark):
    rows = [(i, f"T{i}", "en", "s", 1, "x", 1, "k") for i in range(20)]
    odd = spark.createDataFrame(rows, SCHEMA + ", g string, idx long, h string")
    assert sorted(map(str, (tuple(r) for r in manifest(odd).collect()))) == sorted(map(str, _brute([r[:5] for r in rows])))
    assert manifest(odd.limit(0)).collect() == []


def test_numbering_in_many_slices(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) as g", "id div 10 as k", "'h' as h")
    out = numbered(rows, ["k"], slice_rows=37).collect()
    for g in "012":
        mine = sorted((r.idx, r.k) for r in out if r.g == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)
        assert {r.cnt for r in out if r.g == g} == {len(mine)}
    levels, tops = fold_up(numbered(rows, ["k"]))
    assert len(levels) == 3 and tops.count() == 3
