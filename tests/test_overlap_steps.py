from __future__ import annotations

import random

from pyspark.sql import functions as F

from orbitree.operators import overlap
from orbitree.operators.overlap import square_boxes

SQUARE = "object_id long, x0 double, y0 double, size double, theta double"


def test_boxes_that_touch_overlap_by_their_centres(spark):
    rows = [(i * 40 + j, i / 10, 200 + j / 10, float(1 + (i + j) % 4), 0.0) for i in range(40) for j in range(40)]
    hit = lambda a, b: abs(a[1] - b[1]) <= (a[3] + b[3]) / 2 and abs(a[2] - b[2]) <= (a[3] + b[3]) / 2
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and hit(a, b)}
    found = [(r.a, r.b) for r in overlap.overlap_join(spark.createDataFrame(rows, SQUARE), square_boxes).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs


def test_thinning_in_steps_writes_few_overlaps(spark, monkeypatch):
    written, write = [], overlap.materialize

    def counted(df, tag):
        out = write(df, tag)
        written.extend([out.count()] * (tag == "overlaps"))
        return out

    monkeypatch.setattr(overlap, "materialize", counted)
    draw = random.Random(3)
    rows = [(i * 7, draw.randrange(100) / 10, draw.randrange(100) / 10, float(1 + i % 4), 0.0) for i in range(1500)]
    kept = []
    for r in rows:
        if not any(abs(r[1] - k[1]) <= (r[3] + k[3]) / 2 and abs(r[2] - k[2]) <= (r[3] + k[3]) / 2 for k in kept):
            kept.append(r)
    squares = spark.createDataFrame(rows, SQUARE).repartition(3)
    assert sorted(r.object_id for r in overlap.thin_non_overlapping(squares, square_boxes, first=50).collect()) == [k[0] for k in kept]
    assert max(written) < 2000 < overlap.overlap_join(squares, square_boxes).count()
    assert {r.object_id for r in overlap.overlapping(squares, squares.where(F.col("object_id") == 0), square_boxes).collect()} >= {0}
