"""Readers and writers of object tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitree.functions.geometry import deg2rad_last
from orbitree.operators.overlap import ranked

SCHEMAS = {
    "squares": "object_id long, x0 double, y0 double, size double, theta double",
    "cuboids": "object_id long, x0 double, y0 double, z0 double, w double, h double, d double, theta double, psi double, phi double",
    "ellipses": "object_id long, a double, b double, h double, k double",
    "segments2d": "object_id long, x0 double, y0 double, length double, theta double",
    "segments3d": "object_id long, x0 double, y0 double, z0 double, length double, theta double, phi double",
    "polygons": "object_id long, vertices array<struct<x:double,y:double>>",
}
_DEGREES = {"squares": "theta", "cuboids": "phi"}


def read_objects(spark: SparkSession, path: str, kind: str, degrees: bool = True, limit: int | None = None) -> DataFrame:
    """A Parquet table of one kind with its schema; the stored angle in degrees becomes radians."""
    df = spark.read.schema(SCHEMAS[kind]).parquet(path)
    df = deg2rad_last(df, _DEGREES[kind]) if degrees and kind in _DEGREES else df
    return df.orderBy("object_id").limit(limit) if limit is not None else df


def write_objects(df: DataFrame, path: str, kind: str) -> None:
    names = [part.split()[0] for part in SCHEMAS[kind].split(", ")]
    df.select(*names).write.mode("overwrite").parquet(path)


def read_npy(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw .npy matrices, one object per row; the object id is the row number in its file.

    Files are read whole, one at a time per task; pickled arrays are refused."""
    return unpack_npy(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), kind)


def unpack_npy(files: DataFrame, kind: str) -> DataFrame:
    """Objects of (file, content) rows, each content a .npy matrix."""
    names = [part.split()[0] for part in SCHEMAS[kind].split(", ")][1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.file, pdf.content):
                rows = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                out = pd.DataFrame(rows[:, : len(names)], columns=names[: rows.shape[1]])
                for missing in names[rows.shape[1] :]:
                    out[missing] = 0.0
                yield out.assign(object_id=np.arange(len(out)), file=name)[["file", "object_id", *names]]

    df = files.select("file", "content").mapInPandas(run, f"file string, {SCHEMAS[kind]}")
    return deg2rad_last(df, _DEGREES[kind]) if kind in _DEGREES else df


def pack_npy(df: DataFrame, kind: str, rows: int = 1_000_000) -> DataFrame:
    """(file, content): objects in id order as .npy matrices of ``rows`` rows, named part-0.npy and so
    on; one task holds one matrix."""
    names = [part.split()[0] for part in SCHEMAS[kind].split(", ")][1:]
    placed = ranked(df.select("object_id", *names)).withColumn("part", F.floor((F.col("rank") - 1) / F.lit(rows)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        body = io.BytesIO()
        np.save(body, pdf.sort_values("rank")[names].to_numpy(dtype=float), allow_pickle=False)
        return pd.DataFrame({"file": [f"part-{key[0]}.npy"], "content": [body.getvalue()]})

    return placed.groupBy("part").applyInPandas(pack, "file string, content binary")


def write_prefix_snapshots(kept: DataFrame, path: str, sizes: tuple[int, ...] = (1000, 5000, 10000, 25000, 35000, 45000, 50000)) -> DataFrame:
    """Write the ranked objects, partitioned by the smallest snapshot that holds them."""
    snap = F.lit(None).cast("int")
    for n in sorted(sizes, reverse=True):
        snap = F.when(F.col("rank") <= n, n).otherwise(snap)
    out = ranked(kept).withColumn("snapshot", snap)
    out.write.mode("overwrite").partitionBy("snapshot").parquet(path)
    return out


def read_snapshot(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n objects: partitions up to n are read, the others are pruned."""
    return spark.read.parquet(path).where((F.col("snapshot") <= n) & (F.col("rank") <= n))
