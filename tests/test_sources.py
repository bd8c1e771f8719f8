from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitree.operators.router import Node
from orbitree.sources.objects import read_npy, read_objects, read_snapshot, write_objects, write_prefix_snapshots
from orbitree.streaming.routing import route_stream


def test_npy_and_parquet(spark, tmp_path):
    rows = np.array([[1.0, 2.0, 3.0, 90.0], [4.0, 5.0, 1.0, 180.0]])
    np.save(tmp_path / "sq.npy", rows)
    df = read_npy(spark, str(tmp_path / "sq.npy"), "squares").orderBy("object_id")
    assert [r.theta for r in df.collect()] == pytest.approx([np.pi / 2, np.pi])
    write_objects(df, str(tmp_path / "p"), "squares")
    assert read_objects(spark, str(tmp_path / "p"), "squares", degrees=False).count() == 2


def test_snapshots(spark, tmp_path):
    kept = spark.range(0, 60, 2).withColumnRenamed("id", "object_id")
    write_prefix_snapshots(kept, str(tmp_path / "s"), (5, 20))
    assert sorted(r.object_id for r in read_snapshot(spark, str(tmp_path / "s"), 5).collect()) == [0, 2, 4, 6, 8]
    assert read_snapshot(spark, str(tmp_path / "s"), 20).count() == 20


def test_stream_of_points(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("point_id"), (F.col("id") / 50).alias("x"), F.lit(0.5).alias("y")).write.parquet(str(tmp_path / "in"))
    tree = {"0": Node(np.array([[0.0, 0.5], [1.0, 0.5]]), None)}
    points = spark.readStream.schema("point_id long, x double, y double").parquet(str(tmp_path / "in"))
    query = route_stream(points, tree, 2, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50
    assert {r.visited[-1] for r in out.where("x < 0.4").collect()} == {"00"}
