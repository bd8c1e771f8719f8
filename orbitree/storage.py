"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; where it is unset, a temporary folder of the
    session if the master is a single machine (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("orbitree.shared.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="orbitree-")
        spark.conf.set("orbitree.shared.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/orbitree-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
