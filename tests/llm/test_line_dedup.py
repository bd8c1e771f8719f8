from __future__ import annotations

import random
import re

from orbitree.llm.line_dedup import delete_repeated_lines, repeated_lines


def brute_all(rows, min_chars):
    """Lines to delete by comparing blocks of every length."""
    docs = {i: t.split("\n") for i, t in sorted(rows)}
    gone = {i: set() for i in docs}
    for k in range(1, max(map(len, docs.values())) + 1):
        seen = set()
        for i, lines in docs.items():
            for p in range(len(lines) - k + 1):
                block = "\n".join(lines[p : p + k])
                if block in seen and len(re.sub(r"[\x20\x09-\x0d]", "", block)) >= min_chars:
                    gone[i] |= set(range(p, p + k))
                seen.add(block)
    return {i: v for i, v in gone.items() if v}


def test_matches_brute_force(spark):
    draw = random.Random(11)
    pool = [f"line {i} " + "x" * draw.randrange(20) for i in range(12)]
    runs = [[draw.choice(pool) for _ in range(n)] for n in (1, 2, 3, 5, 9, 17)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(draw.randrange(1, 4)):
            lines += draw.choice(runs) + [f"own {i} {draw.random()}"] * draw.randrange(3)
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for min_chars in (1, 25, 60):
        spans = {r.doc_id: {n for s in r.spans for n in range(s.start, s.end)} for r in repeated_lines(docs, min_chars=min_chars).collect()}
        assert brute_all(rows, min_chars) == spans
        for r in delete_repeated_lines(docs, min_chars=min_chars, drop_emptied=False).collect():
            lines = dict(rows)[r.doc_id].split("\n")
            assert r.text == "\n".join(x for n, x in enumerate(lines) if n not in spans.get(r.doc_id, set()))


def test_edge_cases(spark):
    schema = "doc_id long, text string, n_chars long, spans string"
    assert delete_repeated_lines(spark.createDataFrame([], schema)).count() == 0
    line = "y" * 300
    rows = [(1, f"{line}\nend", 304, "a"), (2, line, 300, "b"), (3, None, None, "c"), (4, "", 0, "d"), (None, line, 300, "e"), (5, f"head\n{line}", 305, "f")]
    out = delete_repeated_lines(spark.createDataFrame(rows, schema))
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert out.columns == ["doc_id", "text", "n_chars", "spans"]
    assert got == sorted([("1", f"{line}\nend", 304), ("3", None, None), ("4", "", 0), ("None", line, 300), ("5", "head", 4)])


def test_runs_of_every_length_go_whole(spark):
    def run(name, *sizes):
        return [(f"{name}{i}" + "z" * n)[:n] for i, n in enumerate(sizes)]

    runs = [run("a", 80, 80, 80), run("b", *[49] * 7), run("c", 150, 150, 10), run("d", 90, 0, 0, 90, 0, 30, 0), run("e", 60, 60, 60), run("f", 10, 199, 0, 0, 1)]
    rows = [(i, "\n".join([f"own {i}", *r, "", f"end {i}"])) for i, r in enumerate(runs + runs)]
    rows += [(50, "\n".join(runs[0][1:] + runs[1][:5] + runs[2][1:])), (51, "\n".join(runs[1][2:] + runs[1]))]
    draw = random.Random(5)
    pool = ["", "p" * 30, "q" * 70, "r" * 110, "s" * 5]
    rows += [(60 + i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 14)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for min_chars in (0, 1, 200):
        spans = {r.doc_id: {n for s in r.spans for n in range(s.start, s.end)} for r in repeated_lines(docs, min_chars=min_chars).collect()}
        assert spans == brute_all(rows, min_chars)
    assert spans[6] >= {1, 2, 3} and len(spans[7]) >= 7 and spans[8] >= {1, 2, 3}


def test_rows_that_share_an_id(spark):
    run = [f"line {i} of a run that repeats " + "z" * 40 for i in range(6)]
    unique = [f"only here {i} " + "u" * 60 for i in range(6)]
    rows = [(1, "\n".join(run), "a"), (5, "\n".join([*run, "mine"]), "b"), (5, "\n".join(unique), "c"), (5, "\n".join(unique), "d"), (6, "\n".join([*unique, "end"]), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = {r.digest: r.text for r in delete_repeated_lines(docs).collect()}
    assert out == {"a": rows[0][1], "b": "mine", "c": rows[2][1], "d": rows[2][1], "e": "end"}
    many = [(7, "\n".join([f"head {i}", *run]), str(i)) for i in range(40)]
    left = delete_repeated_lines(spark.createDataFrame(many, "doc_id long, text string, digest string")).collect()
    assert sorted(len(r.text.split("\n")) for r in left) == [1] * 39 + [7]
