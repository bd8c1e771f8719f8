from __future__ import annotations

import random
from html import escape

from itertools import product
from time import perf_counter

import numpy as np
import pytest

from orbitree.llm.html import Page, _forest, _told, extract_text, marginals, page_texts, parse, train, train_on

WORDS = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "m", "lt")]


def _line(draw, lo=8, hi=30):
    return " ".join(draw.choice(WORDS) for _ in range(draw.randrange(lo, hi))).capitalize() + "."


def _page(draw, shell):
    """A page and its main text, in one of several layouts."""
    title = _line(draw, 3, 7)[:-1]
    blocks = [_line(draw) for _ in range(draw.randrange(3, 9))]
    points = [_line(draw, 1, 5)[:-1] for _ in range(draw.randrange(0, 4))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{escape(b)}</p>" for b in blocks) + (f"<ul>{''.join(f'<li>{x}</li>' for x in points)}</ul>" if points else "")
    want = "\n".join([title, *blocks, *points])
    menu = "<ul>" + "".join(f'<li><a href="/{i}">{_line(draw, 1, 3)[:-1]}</a></li>' for i in range(6)) + "</ul>"
    aside, comment, legal = _line(draw, 4, 9), _line(draw, 5, 15), "All rights reserved by the publisher."
    if shell == "article":
        return f'<body><nav>{menu}</nav><article>{body}<section class="comments"><p>{comment}</p></section></article><aside><p>{aside}</p></aside><footer>{legal}</footer></body>', want
    if shell == "main":
        return f'<body><header><a href="/">Site</a>{menu}</header><main>{body}<form><label>Mail</label><button>Send</button></form></main><div class="sidebar"><p>{aside}</p></div><footer>{legal}</footer></body>', want
    if shell == "div":
        return f'<body><div id="header">{menu}</div><div class="post-content">{body}</div><div class="ad">{aside}</div><div id="kommentare"><p>{comment}</p></div><div id="footer">{legal}</div></body>', want
    return f'<body><nav>{menu}</nav><div>{body}</div><div class="cookieNotice">We use cookies here.</div><footer><p>{legal}</p></footer></body>', want


def test_held_out_blocks():
    draw = random.Random(12)
    model = train([parse(_page(draw, draw.choice(["article", "main", "div"]))[0]) for _ in range(150)])
    for shell, least in (("article", 0.99), ("main", 0.99), ("div", 0.99), ("bare", 0.95)):
        hit = got_n = want_n = 0
        for _ in range(60):
            html, want = _page(draw, shell)
            got, wanted = page_texts([html], model)[0].split("\n"), want.split("\n")
            hit += len(set(got) & set(wanted))
            got_n += len(got)
            want_n += len(wanted)
        assert hit >= least * got_n and hit >= least * want_n, (shell, hit / max(got_n, 1), hit / want_n)


def test_short_headings_and_lists_stay_and_notices_go():
    draw = random.Random(13)
    model = train([parse(_page(draw, "article")[0]) for _ in range(100)])
    long = _line(draw, 30, 40)
    for known in (model, train([])):
        assert page_texts([f"<article><h1>T</h1><ul><li>alpha</li><li><a>beta</a></li></ul><p>{long}</p></article>"], known) == [f"T\nalpha\nbeta\n{long}"]
        html = f'<nav><ul><li><a href="x">Menu</a></li></ul></nav><article><p>{long}</p><div class="werbung"><p>Buy now.</p></div><div class="kommentare"><p>Nice text, thanks.</p></div></article>'
        assert page_texts([html], known) == [long]


def test_a_very_long_page_and_odd_rows(spark):
    draw = random.Random(14)
    model = train([parse(_page(draw, "article")[0]) for _ in range(50)])
    lines = [_line(draw) for _ in range(20_000)]
    rows = [(1, "u", "<nav><a>M</a></nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"), (1, "v", "<p"), (2, None, None), (None, "w", "")]
    got = sorted((str(r.page_id), r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect())
    assert got == sorted([("1", len("\n".join(lines))), ("1", 0), ("2", 0), ("None", 0)])


@pytest.fixture(scope="module")
def given(spark):
    """The model as the query trains it."""
    return train_on(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


LONG = "A sentence that is long enough to be a paragraph of its own, with some words more than a menu has."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article><h1>T</h1><ul><li>alpha</li><li><a>beta</a></li></ul><p>{LONG}</p></article>", f"T\nalpha\nbeta\n{LONG}"),
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p></article>', f"Title\n{LONG}"),
        (f'<nav><a href="/">Home</a></nav><main class="search-results-page related"><p>{LONG}</p></main>', LONG),
        (f"<body><p>{LONG}</p><p>Short one.</p></body>", f"{LONG}\nShort one."),
        ("just plain text", "just plain text"),
        (f"<table><tr><td><div>{LONG}</div></td></tr></table>", LONG),
        (f'<article><p>{LONG}</p><section id="c"><h3>3 Comments</h3><p>Nice post by you.</p></section></article>', LONG),
        (f"<article><p>super<wbr>long foo<script>x()</script>bar a<!-- c -->b one<br>two</p><p>{LONG}</p></article>", f"superlong foobar ab one two\n{LONG}"),
        ("<nav><ul><li><a>Menu</a></li></ul></nav><footer>Legal text of the site.</footer>", ""),
        ("<article><p title='it > that' data-x=a\"b>kept</p><p don't>too</p></article>", "kept\ntoo"),
    ],
)
def test_pages_of_other_layouts(given, html, want):
    assert page_texts([html], given) == [want]


@pytest.mark.parametrize("make", [lambda n: "<a " * n + '"', lambda n: '<a ="' * n, lambda n: "<x>" * (n // 20) + "</y>" * (n // 20) + "t", lambda n: "<p><x>" * (n // 20) + "t", lambda n: "a <b " * n, lambda n: "<!-- " * n, lambda n: "<li>" * (n // 20) + "</ul>" * n])
def test_odd_pages_take_linear_time(given, make):
    began = perf_counter()
    page_texts([make(200_000)], given)
    assert perf_counter() - began < 8


def test_marginals_equal_enumeration(given):
    draw = random.Random(8)
    for n in range(1, 13):
        page = Page()
        for i in range(n):
            leaf = i > 0 and draw.random() < 0.4
            up = draw.choice([j for j in range(i) if page.text[j] is None]) if i else -1
            page.add(up, [(draw.randrange(len(given.weights)), draw.random() / 4) for _ in range(2)], draw.random() < 0.1, draw.random() < 0.2, "t" if leaf else None)
        f = _forest([_told(page)])
        score, total, each = f.score(given.weights), 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=n):
            power = sum(s * (v - 0.5) for s, v in zip(score, labels)) + sum(given.edge[f.kind[i], labels[f.parent[i]], labels[i]] for i in range(1, n))
            total += np.exp(power)
            each += np.exp(power) * np.array(labels)
        assert marginals([page], given) == pytest.approx(each / total, abs=1e-9)
