from __future__ import annotations

import random
import textwrap

from orbitree.llm.licenses import NOTICES, scan_licenses, train


def test_wrapped_and_embedded_notices(spark):
    draw = random.Random(8)
    ordinary = [" ".join(f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.randrange(50)}" for _ in range(12)) for _ in range(300)]
    model = train(ordinary[:200])
    long = [("MIT", 2), ("BSD", 1), ("GPL-3.0", 1), ("LGPL", 1), ("AGPL", 1), ("ISC", 1), ("Apache-2.0", 1)]
    rows, want = [], []
    for family, i in long:
        notice = NOTICES[family][i]
        for mark in ("", " * ", "# ", "// "):
            rows.append("\n".join(["import a", "", *(mark + x for x in textwrap.wrap(notice, 60)), "", ordinary[210]]))
            want.append({(2, family)})
        rows.append(" ".join(ordinary[100:180] + [notice] + ordinary[180:260]))
        want.append({(0, family)})
    rows += ["\n".join(ordinary[i : i + 20]) for i in range(200, 280)]
    want += [set()] * 80
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: {(x.line, x.family) for x in r.licenses if x.confirmed} for r in scan_licenses(docs, model).collect()}
    assert [got[i] for i in range(len(rows))] == want
