"""Tables on disk in the order of a number, with a manifest of which file has which numbers.

Suffix orders, the symbols before them and common prefixes are kept so: a range of rows reads only
the files that have some of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def save(table: DataFrame, path: str, *, at: str = "sa_idx", files: int | None = None) -> None:
    """Write the rows by ranges of at, sorted, then the manifest (file, first, last, rows)."""
    dealt = table.repartitionByRange(files, at) if files else table.repartitionByRange(at)
    dealt.sortWithinPartitions(at).write.mode("overwrite").parquet(f"{path}/rows")
    written = table.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), at)
    found = written.groupBy("file").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    found.select("*", F.lit(at).alias("at"), F.lit(VERSION).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # a row for each file


def manifest(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(f"{path}/manifest")
    other = found.where(F.col("version") != VERSION).first()
    if other:
        raise ValueError(f"{path}: version {other['version']}, not {VERSION}")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    manifest(spark, path)
    return spark.read.parquet(f"{path}/rows")


def rows_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The rows numbered first to last, from the files that have some of them."""
    rows = manifest(spark, path)
    some = rows.where((F.col("first") <= last) & (F.col("last") >= first)).orderBy("first").select("file", "at").collect()  # files of one range
    every = spark.read.parquet(f"{path}/rows")
    if not some:
        return every.limit(0)
    return spark.read.schema(every.schema).parquet(*[f"{path}/rows/{x['file']}" for x in some]).where(F.col(some[0]["at"]).between(first, last))
