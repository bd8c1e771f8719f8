from __future__ import annotations

import hashlib
import random

from orbitree.llm.phrases import repeated_phrases


def brute(rows, window):
    docs = {i: (t or "").split() for i, t in rows}
    first = {}
    for i in sorted(docs):
        for p in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][p : p + window]), i)
    out = {}
    for i, words in docs.items():
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_matches_brute_force(spark):
    draw = random.Random(5)
    vocab = [f"v{i}" for i in range(30)]
    make = lambda n: [draw.choice(vocab) for _ in range(n)]
    passages = [make(n) for n in (49, 50, 51, 75, 120)]
    rows = []
    for i in range(40):
        words = make(draw.randrange(0, 60))
        for _ in range(draw.randrange(3)):
            passage = draw.choice(passages)
            cut = draw.randrange(0, 10)
            words += passage[cut:] + make(draw.randrange(5))
        rows.append((i, " ".join(words)))
    rows += [(100, "same " * 120), (101, "same " * 130), (102, None), (103, ""), (104, rows[3][1]), (105, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_phrases(docs).collect()}
    assert got == brute(rows, 50)


def test_edge_cases(spark):
    assert repeated_phrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(2, text, "a"), (2, text, "b"), (None, text, "c"), (5, text, "d")], "doc_id long, text string, phrases string")
    got = sorted((str(r.doc_id), r.n_removed, len(r.spans)) for r in repeated_phrases(docs).collect())
    assert got == [("2", 0, 0), ("2", 0, 0), ("5", 60, 1), ("None", 0, 0)]


def test_repeated_ids_are_judged_by_their_texts(spark):
    draw = random.Random(9)
    make = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    passage = make(70)
    rows = [(1, f"{make(20)} {passage}"), (2, f"{passage} {make(150)}"), (2, make(12)), (2, f"{make(300)} {passage}"), (3, passage), (3, passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 90, 0), (2, 12, 0), (2, 220, 70), (2, 370, 70), (3, 70, 70), (3, 70, 70)]


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    from orbitree.llm import phrases

    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a {text}"), (2, f"b c {text}")], "doc_id long, text string")
    assert [r.n_removed for r in repeated_phrases(docs).orderBy("doc_id").collect()] == [0, 80]
    table = phrases.pa.table({"words": phrases.pa.array([], phrases.pa.binary())})
    assert phrases._compiled(table) is None


def test_a_very_long_text(spark):
    draw = random.Random(10)
    passage = [f"p{draw.randrange(10**6)}" for _ in range(60)]
    long = [f"x{draw.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_100] + passage)), (3, " ".join(long[:1000] + passage))]
    got = {r.doc_id: r.n_removed for r in repeated_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 100, 3: 1060}
