"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitree.storage import materialize

__all__ = ["digest_of", "has_repeats", "materialize", "numbered", "row_keys", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_repeats(df: DataFrame, key: str) -> bool:
    """Whether a non-null key occurs on more than one row."""
    return not df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def numbered(rows: DataFrame, order: list[str], slice_rows: int = 1_000_000) -> DataFrame:
    """Adds idx (0-based, by ``order`` inside each group g) and cnt (rows of the group), without one
    window over a group: rows are cut into sorted slices, slices are counted, then rows inside them.
    Rows that tie in every column are dealt over several slices; they are alike, so their order is free."""
    spark = rows.sparkSession
    n = rows.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // slice_rows + 1)
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    cut = materialize(spread.repartitionByRange(slices, "g", *(F.col(c).asc_nulls_first() for c in order), "tie").withColumn("slice", F.spark_partition_id()), "slices")
    counts = cut.groupBy("g", "slice").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("g")
    base = counts.select("g", "slice", (F.sum("n").over(by_group.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"), F.sum("n").over(by_group).alias("cnt"))
    inside = F.row_number().over(Window.partitionBy("g", "slice").orderBy(*(F.col(c).asc_nulls_first() for c in order), "tie"))
    return cut.withColumn("inside", inside).join(base, ["g", "slice"]).withColumn("idx", F.col("base") + F.col("inside") - 1).drop("slice", "tie", "inside", "base")


def digest_of(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def row_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, row): the distinct documents of rows (doc_id, text) whose ids repeat, numbered in
    order of id, then digest. Rows with the same id and text are one document."""
    known = rows.select("doc_id", digest_of(F.col("text")).alias("digest")).distinct().withColumn("g", F.lit(""))
    return materialize(numbered(known, ["doc_id", "digest"]).select("doc_id", "digest", F.col("idx").alias("row")), "rows")
