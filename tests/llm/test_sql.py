"""Operators and pipeline against their SQL, and on odd tables."""

from __future__ import annotations

import random

import duckdb
import pytest

import corpus_pipeline
from orbitree.llm import oracles, registry
from orbitree.llm.decontaminate import contaminated
from orbitree.llm.line_dedup import line_dedup_report
from orbitree.llm.near_dedup import near_duplicates
from orbitree.llm.quality import quality

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "pages")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _same(df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(str([r[n] for n in order]) for r in df.collect())
    assert got == sorted(str([r[names.index(n)] for n in order]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_equals_sql(spark, con, name):
    _same(registry.queries()[name](spark, DATA), con.execute(registry.oracle_sql()[name]))


def test_pipeline_equals_sql(spark, con):
    _same(corpus_pipeline.run(spark, DATA), con.execute(corpus_pipeline.ORACLE_SQL))


def _table(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return c


def test_quality_equals_sql_on_common_lines(spark):
    draw = random.Random(20)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for i in range(150):
        own = [" ".join(word() for _ in range(20)) for _ in range(4)]
        rows.append((i, "\n".join([f"Menu {i % 2} Home", *own, "", f"Report {i} of day {i}"]), "en", draw.choice(["a", "b", None]), 0))
    rows += [(200 + i, rows[0][1], "en", "a", 0) for i in range(40)] + [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "x y z " * 40, "en", "b", 0)]
    con = _table(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    _same(quality(docs), con.execute(oracles.quality_sql()))
    verdict = {r.doc_id: r for r in quality(docs).collect()}
    # lines that differ in their numbers are different lines, so the reports stay
    assert all(verdict[i].removed_chars == len("Menu0Home") for i in range(150))


def test_position_of_a_shared_run_does_not_matter(spark):
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(10**6)}"
    item = [word() for _ in range(20)]
    docs = [(s, " ".join([word() for _ in range(20 + s)] + item[:10] + [word() for _ in range(9)]), "en", "a", 0) for s in range(12)]
    numbers = "What is 12 + 7 * 3 - 5 / 2 + 11 * 4 ?"
    docs += [(20, f"some words in front {numbers} and more", "en", "a", 0), (21, f"some words in front {numbers.replace('7', '8').replace('2', '9')} and more", "en", "a", 0), (22, "before too short item after", "en", "a", 0)]
    items = [(1, " ".join(item)), (2, numbers), (3, "too short item")]
    found = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(s, 1) for s in range(12)} | {(20, 2), (22, 3)}
    con = _table(docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    _same(contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")), con.execute(oracles.decontamination_sql()))


def test_families_that_share_a_stronger_centre(spark):
    draw = random.Random(22)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]

    def near(words, n):
        words = list(words)
        for p in draw.sample(range(len(words)), n):
            words[p] = f"x{draw.randrange(10**6)}"
        return words

    rows = [(i, " ".join(near(base, draw.randrange(0, 4))), "en", "a", 0) for i in range(25)]
    other = near(base, 12)
    rows += [(100 + i, " ".join(near(other, 1)), "en", "a", 0) for i in range(25)]
    rows += [(200 + i, " ".join(near(base, draw.randrange(6, 12))), "en", "a", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for threshold in (80, 85):
        _same(near_duplicates(docs, threshold=threshold), _table(rows).execute(oracles.near_dedup_sql(threshold=threshold)))


def test_very_long_texts(spark):
    draw = random.Random(23)
    lines = [" ".join(f"w{draw.randrange(10**5)}" for _ in range(10)) for _ in range(12_000)]
    rows = [(1, "\n".join(lines), "en", "a", 0), (2, "\n".join(lines[:6000] + ["end"]), "en", "a", 0), (3, "y" * 1_000_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_removed for r in line_dedup_report(docs).collect()} == {1: 0, 2: 6000, 3: 0}
    assert {r.doc_id: (r.n_words, r.kept) for r in quality(docs).collect()} == {1: (120_000, True), 2: (60_001, True), 3: (1, False)}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    leaks = contaminated(docs, spark.createDataFrame([(7, lines[11_000])], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in leaks.collect()] == [(1, 7)]


def test_pipeline_on_odd_tables(spark):
    draw = random.Random(24)
    text = lambda n: "\n".join(" ".join(f"w{draw.randrange(10**6)}" for _ in range(12)) for _ in range(n))
    good = text(8)
    rows = [(1, good, "en", "s1", 5, "x", 1, "k"), (2, good, None, None, None, None, None, None), (2, good, "en", "s1", 5, "x", 1, "k"), (3, None, "en", "s1", None, "x", 1, "k"), (4, "", "en", "s1", 0, "x", 1, "k"), (None, text(8), "en", "s1", 9, "x", 1, "k"), (5, text(9), "de", "s2", 9, "x", 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA + ", host string, version long, key string")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.materialize(stage(spark, out, DATA), "odd")
            assert out.columns == docs.columns
        taken = corpus_pipeline.STAGES[-1][1](spark, out, DATA)
        assert {r.doc_id for r in taken.collect()} <= {1, 2, 5, None}
        assert (out.count() > 0) == (table is docs)
