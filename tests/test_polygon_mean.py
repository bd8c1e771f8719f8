from __future__ import annotations

from orbitree.plans import catalog


def test_mean_of_a_polygon_is_summed_as_in_sql(spark):
    ring = [{"x": x, "y": y} for x, y in ((262.88, 28.0), (260.4, 29.52), (257.2, 28.0), (260.4, 25.759999999999998))]
    rows = spark.createDataFrame([(843489, 5343489, 143.1, 9.78, ring)], "object_id long, point_id long, x double, y double, vertices array<struct<x: double, y: double>>")
    assert [r.inside for r in catalog._beside_polygon(rows).collect()] == [False]
