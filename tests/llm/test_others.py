from __future__ import annotations

import hashlib
import random
import re
from html import escape
from math import log2

import duckdb
import pytest

from orbitree.llm.chat import CHAT_SQL, format_chats
from orbitree.llm.decontaminate import contaminated, drop_contaminated
from orbitree.llm.html import extract_text, train_on
from orbitree.llm.licenses import NOTICES, scan_licenses, train
from orbitree.llm.mixing import mix, mix_sql
from orbitree.llm.secrets import WINDOW, entropy_spans, scan, secret_report


def _same(spark_rows, relation):
    names = [d[0] for d in relation.description]
    rows = relation.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(str, ([r[names[i]] for i in order] for r in spark_rows))) == sorted(map(str, ([r[i] for i in order] for r in rows)))


# chat


def test_chat_matches_sql(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(60):
        base = draw.randrange(4)
        for turn in range(draw.randrange(1, 6)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"text {base} {turn}" if draw.random() < 0.9 else f"other {conv}"))
    rows += [(100, None, "user", None), (100, 1, None, ""), (None, 0, "user", "x"), rows[0], rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert _same(format_chats(turns).collect(), con.execute(CHAT_SQL))
    assert format_chats(turns.limit(0)).count() == 0
    named = turns.selectExpr("*", "'x' AS hash", "1 AS n_equal", "'y' AS turns", "role AS hashes")
    assert sorted(map(str, format_chats(named).collect())) == sorted(map(str, format_chats(turns).collect()))
    long = spark.createDataFrame([(1, 0, "user", "z" * 1_000_000), (2, 0, "user", "z" * 1_000_000), (2, 1, "assistant", "ok")], turns.schema)
    assert [(r.conv_id, r.n_chars) for r in format_chats(long).collect()] == [(2, 1_000_000 + len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"))]


# secrets


def _brute(text):
    flags = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    out = []
    for k, (name, pattern) in enumerate(flags):
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16}[name]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


SECRETS = ["", "é password = \"abcdefghijkl\" x", "token:secret: abcdefghijklmnopq", "API_KEY='0123456789abcdef0'", "AKIA AKIA12345678901234 AKIAAKIA1234567890", "toKen=abcdefghijklmnop", "deadbeefdeadbeef", "deadbeefdeadbee", "secret==abcdefghijklm passwd : short", "apikey=x" * 5]


@pytest.mark.parametrize("text", SECRETS)
def test_base_secrets(text):
    assert [s for s in scan(text) if s[1] < 3] == _brute(text)


def test_entropy_matches_recount():
    draw = random.Random(1)
    for _ in range(30):
        candidate = "".join(draw.choice("abcdefgh0123456789ABCXYZ+/") for _ in range(draw.randrange(20, 60)))
        need = {True: 3.6}.get(bool(re.fullmatch("[A-Za-z0-9]+", candidate)), 3.7)
        covered = set()
        for i in range(len(candidate) - WINDOW + 1):
            part = candidate[i : i + WINDOW]
            if -sum(part.count(c) / WINDOW * log2(part.count(c) / WINDOW) for c in set(part)) >= need - 1e-9:
                covered |= set(range(i, i + WINDOW))
        assert {p for lo, hi in entropy_spans(candidate) for p in range(lo, hi)} == covered
    for harmless in ("12345678901234567890123", "internationalization_of_words", "123e4567-e89b-12d3-a456-426614174000", "some-long-path/of/words"):
        assert entropy_spans(harmless) == []


def test_secret_report(spark):
    rows = [(i, t, "s") for i, t in enumerate(SECRETS)] + [(None, None, None), (3, "AKIA12345678901234", "z")]
    for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect():
        if r.doc_id is not None and r.doc_id != 3:
            base = _brute(SECRETS[r.doc_id])
            listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))


# pages


def _page(lines, shell):
    body = "".join(f"<p>{escape(x)}</p>" for x in lines)
    if shell == "article":
        return f'<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><a href="/a">Menu</a></nav><div class="ad">Buy this now.</div><article>{body}<section class="comments"><p>Nice post, thanks for it all.</p></section></article><footer>&copy; us</footer></body></html>'
    return f'<body><div id="header">Site</div><ul class="menu"><li><a href="/">Home</a></li></ul><div class="content">{body}</div><aside>Other stories to read</aside><div id="cookie-notice">We use cookies on this site.</div><form><button>Go</button></form></body>'


def test_main_text(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for i in range(80):
        lines = [" ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(8, 30))) + " & <b> é." for _ in range(draw.randrange(1, 6))]
        rows.append((i, f"u{i}", _page(lines, "article" if i % 4 else "plain"), 1))
        want[i] = "\n".join(lines)
    rows += [(500, None, None, 1), (501, "u", "", 1), (None, "u", "<p", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    model = train_on(pages)
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(pages, model).collect()}
    assert all(got[i] == (t, len(t)) for i, t in want.items())
    assert got[500] == got[501] == ("", 0)
    assert extract_text(pages.limit(0), train_on(pages.limit(0))).count() == 0


# mixing


def test_mix_matches_sql_and_budget(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.randrange(0, 30))) + f" {i}", draw.choice(["en", "de", None]), draw.choice(["src0"] * 5 + ["src1", "src2", "src7", None, "odd"])) for i in range(300)]
    rows += [rows[0], (None, "a b c", "en", "src1"), (900, None, "en", "src2"), (901, "", "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS domain")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    for share in (0.3, 0.9, 1.7, 5.0):
        got = mix(docs, budget_share=share).collect()
        assert _same(got, con.execute(mix_sql(budget_share=share)))
        total = sum(len(t.split()) for _, t, _, _ in rows if t)
        assert sum(r.n_tokens * r.copies for r in got) <= share * total
    assert mix(docs.limit(0)).count() == 0


# licences


def test_licences_held_out(spark):
    draw = random.Random(6)
    ordinary = [" ".join(f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.randrange(50)}" for _ in range(12)) for _ in range(300)]
    model = train(ordinary[:200])
    rows, want = [], {}
    for i, (family, notices) in enumerate(NOTICES.items()):
        text = f"{ordinary[200 + i]}\n{draw.choice(ordinary)[:20]} {notices[0].upper()}\n{ordinary[230 + i]}"
        rows.append((i, text, family))
        want[i] = {(1, family)}
    rows += [(100 + i, t, None) for i, t in enumerate(ordinary[250:])] + [(500, None, None), (501, "", None)]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string"), model).collect()
    right = sum({(x.line, x.family) for x in r.licenses if x.confirmed} == want.get(r.doc_id, set()) for r in found)
    assert len(found) == len(rows) and right >= 0.95 * len(rows)
    assert not any(x.confirmed for r in found if r.doc_id >= 100 for x in r.licenses)


# decontamination


ITEMS = [
    (1, "Anna had 12 apples and gave 5 apples to Tom. How many apples does Anna have left after walking 3 km to the market"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge every single morning before breakfast"),
    (3, "too short item"),
    (4, None),
]


def test_leaks(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    docs = [
        (1, f"{filler}. {ITEMS[1][1]} {filler}"),
        (2, f"{filler}. Maria had 31 apples and gave 7 apples to Paul. How many apples does Maria have left after walking 9 miles to the market {filler}"),
        (3, filler),
        (4, f"{filler} {ITEMS[1][1].upper().replace(' ', '%% ')} {filler}"),
        (5, None),
        (6, "too short item"),
        (7, " ".join(str(i) for i in range(300))),
        (None, ITEMS[1][1]),
        (8, f"{filler} the quick brown fox jumps over a lazy cat {filler}"),
        (9, f"{filler} {' '.join(ITEMS[1][1].split()[:12])} {filler}"),
    ]
    table = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'h' AS hash")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    found = {(r.doc_id, r.item_id): r.kind for r in contaminated(table, bench).collect()}
    assert found == {(1, 2): "verbatim", (2, 1): "reparameterised", (4, 2): "verbatim", (9, 2): "verbatim", (6, 3): "verbatim"}
    assert sorted(str(r.doc_id) for r in drop_contaminated(table, bench).collect()) == ["3", "5", "7", "8", "None"]
    assert contaminated(table.limit(0), bench).count() == 0
    assert contaminated(table, bench.limit(0)).count() == 0


# several occurrences of an item


def test_each_occurrence_is_judged_by_itself(spark):
    def told(name, other, *n):
        return f"{name} had {n[0]} apples and gave {n[1]} apples to {other}. How many apples does {name} have left after walking {n[2]} km to the market"

    filler = " ".join(f"f{i}" for i in range(40))
    docs = [
        (1, f"{filler}. {told('Maria', 'Paul', 31, 7, 9)}. {told('Eva', 'Max', 88, 6, 4)}. {told('Ida', 'Jon', 17, 2, 8)}"),
        (2, f"{filler}. {told('Anna', 'Tom', 12, 5, 3)}. {filler}. {told('Eva', 'Max', 88, 6, 4)}"),
    ]
    found = {(r.doc_id, r.item_id): r.kind for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert found == {(1, 1): "reparameterised", (2, 1): "verbatim"}


def test_mix_with_given_weights_and_domains(spark):
    rows = [(i, "w " * 9 + str(i), "en", ("a", "b", "c", "d")[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, budget_share=0.2, domains={"a": "x", "b": "x", "c": "y", "d": "y"}, domain_weights={"x": 3}, source_weights={"a": 4})
    taken = {r.source: r.t for r in got.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    assert taken == {"a": 480, "b": 120, "c": 100, "d": 100}
    assert {r.domain for r in mix(docs, budget_share=0.2, domains={"a": "x"}).collect()} == {"x", ""}
    with pytest.raises(ValueError):
        mix(docs, domain_weights={"x": 0})
