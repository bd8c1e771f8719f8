"""Bloom filter cascades against sets, url verdicts against a direct comparison with each rule."""

from __future__ import annotations

import random
import re

import pytest

from orbitree.llm.cascade import build_cascade
from orbitree.llm.shared import materialize
from orbitree.llm.urls import RULES, judge_urls, listed_by_words, rule_table


@pytest.mark.parametrize(("n", "share", "block"), [(3000, 0.5, 1 << 20), (3000, 0.02, 1 << 20), (2000, 0.4, 37), (5, 1.0, 4), (50, 0.0, 4)])
def test_cascade_is_exact(spark, n, share, block):
    draw = random.Random(n)
    keys = [(f"k{i}", draw.random() < share) for i in range(n)]
    universe = materialize(spark.createDataFrame(keys, "key string, listed boolean"), "universe")
    cascade = build_cascade(universe, block)
    names = [k for k, _ in keys]
    rows = spark.createDataFrame([(i, [*names[i::50], None], "x") for i in range(50)], "id long, names array<string>, _extra string")
    out = cascade.listed(rows, "names")
    assert out.columns == rows.columns
    assert {r.id: r.names for r in out.collect()} == {i: [k for k, v in keys[i::50] if v] for i in range(50)}


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


def _expect(url, rules, hosts):
    host, path = _split(url)
    under = lambda h: host == h or host.endswith("." + h)
    fits = sorted(((len(h + p), len(h.split(".")), v == "block", h + p, v) for h, p, v in rules if host and under(h) and path.startswith(p)))
    verdict = fits[-1][4] if fits else "block" if host and any(under(h) for h in hosts) else "allow"
    return host, path, fits[-1][3] if fits else None, verdict


URLS = [None, "", "nothing", "http://", "http:///en/1", "https://Example.ORG/en/12?x#y", "http://a.example.org/es/", "http://a.example.org/es", "http://badexample.org/es/1", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/2", "http://x.com", "http://x.net/fr/", "http://www.spam-farm.net/en", "http://spam-farm.net.x.net", "http://spamfarm.net/", "http://a.b.c.d.e.f.net:80/fr?http://x.com/fr/", "ÀÉ://ÀÉ.org/ü", "http://..org/", "http://org/", "x://ads.org"]


def test_verdicts(spark):
    draw = random.Random(4)
    urls = [*URLS, *URLS[5:8]] + [f"http://{draw.choice(['www.', 'm.', ''])}{draw.choice(['example', 'casino-win', 'b'])}.{draw.choice(['org', 'com', 'net'])}/{draw.choice(['en', 'fr', 'de', 'es'])}/{draw.randrange(30)}" for _ in range(200)]
    urls.append("http://" + "a." * 200_000 + "example.org/es/" + "p" * 500_000)
    pages = spark.createDataFrame([(i, u, "h", "c", "n") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, names string")
    hosts = listed_by_words(pages)
    assert {"spam-farm.net", "ads.org"} <= {r.host for r in hosts.collect()}
    bad = [r.host for r in hosts.collect()]
    for block in (1 << 20, 3):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark), hosts, block_words=block).collect()}
        assert got == {i: _expect(u, RULES, bad) for i, u in enumerate(urls)}


def test_many_rules_nulls_and_empty_tables(spark):
    draw = random.Random(5)
    part = lambda: draw.choice(["a", "b", "cc"])
    rules = [(".".join(part() for _ in range(draw.randrange(1, 5))), "/" + "/".join(part() for _ in range(draw.randrange(4))), draw.choice(["allow", "block"])) for _ in range(200)]
    rules += [("a.b", "", "block"), ("a", "", "allow")]
    urls = ["http://" + ".".join(part() for _ in range(draw.randrange(1, 6))) + "/" + "/".join(part() for _ in range(draw.randrange(6))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("b", None, "allow"), ("b", "/", None)], "host string, path string, verdict string")
    none = spark.createDataFrame([], "host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, none).collect()}
    assert got == {i: _expect(u, [*rules, ("b", "", "allow")], []) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), table, none).collect() == []
    assert {r.verdict for r in judge_urls(pages, table.limit(0), none).collect()} == {"allow"}
