"""Copies of ranges of contents that stay as they were: taken once, kept as Parquet, opened and checked later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import bytes as b


def ranges_of(contents: DataFrame, key: str, ranges: list[tuple[int, int]], data: str = "content") -> DataFrame:
    """``(key, offset, size, content, sha256)`` for every (offset, size) that lies wholly inside a content."""
    wanted = F.array(*[F.struct(F.lit(o).cast("bigint").alias("offset"), F.lit(n).cast("bigint").alias("size")) for o, n in ranges])
    rows = contents.select(key, F.col(data).alias("_data"), F.explode(wanted).alias("r")).where((F.col("r.offset") >= 0) & (F.col("r.offset") + F.col("r.size") <= b.size(F.col("_data"))))
    part = b.part(F.col("_data"), F.col("r.offset").cast("int"), F.col("r.size").cast("int"))
    return rows.select(key, "r.offset", "r.size", part.alias("content")).withColumn("sha256", F.sha2("content", 256))


def persist(ranges: DataFrame, path: str) -> None:
    """Write a snapshot; one that is there already is not touched."""
    ranges.write.mode("errorifexists").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot as it was written; a range whose digest no longer fits is an error when it is read."""
    rows = spark.read.parquet(path)
    intact = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.lit("a range of the snapshot is damaged")).cast("binary"))
    return rows.withColumn("content", intact)
