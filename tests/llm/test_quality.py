from __future__ import annotations

import re
from collections import Counter

from orbitree.llm.quality import keep_quality, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    covered = {p + j for p, t in enumerate(triples) if count[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_columns(spark):
    texts = [None, "", " \n\t", "a b c a b c", "é é é\né é é\n\x0bz", "x " * 200, " ".join(f"u{i}" for i in range(60)), "a#b*c | <d> & $ % e", "p q r s p q r", "a\n\nb\n \na\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'h' AS source")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def _host(n=60):
    furniture = "Home About Contact Imprint Terms of use and all that belongs to them " * 3
    rows = []
    for i in range(n):
        own = " ".join(f"word{i}x{j}" for j in range(60))
        rows.append((i, f"{furniture}\n{own}", "shop", 10))
    rows.append((900, furniture + "\n" + "\n".join(f"{furniture.upper()}" for _ in range(1)) + "\nlast " + " ".join(f"q{j}" for j in range(5)), "shop", 10))
    return rows, furniture


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rows, furniture = _host()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    verdict = {r.doc_id: r for r in quality(docs).collect()}
    assert all(verdict[i].removed_chars > 0 and verdict[i].kept for i in range(60))
    assert not verdict[900].kept
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert furniture.strip() not in r.text and r.n_chars == len(r.text)


def test_copies_of_one_document_are_no_furniture(spark):
    text = "\n".join(" ".join(f"k{i}n{j}" for j in range(20)) for i in range(5))
    docs = spark.createDataFrame([(i, text, "h") for i in range(80)], "doc_id long, text string, source string")
    assert quality(docs).where("kept").count() == 80


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, host string, key long"
    assert quality(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, " ".join(map(str, range(80))), None, "x", 1), (1, "", "s", "y", 2)], schema)
    assert sorted(r.kept for r in quality(docs).collect()) == [False, False, True]
    assert sorted(str(r.doc_id) for r in keep_quality(docs).collect()) == ["1", "1", "None"]
