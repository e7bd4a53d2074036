"""Reads from text, FASTA and FASTQ files, and the sinks of query results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, skip_empty: bool = False) -> DataFrame:
    """(read_id, seq): a row for each line, numbered from 0 in the order of files and lines.

    A line's place within its part of a file is known as it is read; only the parts' sizes are
    added up. skip_empty leaves empty lines out before they are numbered.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("seq"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    if skip_empty:
        lines = lines.where(F.length("seq") > 0)
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    parts = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # A row for each part of a file that is read: as many as there are tasks.
    return placed.join(F.broadcast(offsets), ["_file", "_start"]).select((F.col("_offset") + F.col("_at") - F.col("_first")).alias("read_id"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records that start with a > that begins a line, and a name; the lines after it
    are one sequence. A > inside a line is part of it."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "^>|\r$", ""), "\r?\n")
    return records.select(F.get(lines, F.lit(0)).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, quality): four lines a record."""
    lines = read_lines(spark, path).withColumns({"_record": F.floor(F.col("read_id") / 4), "_line": F.col("read_id") % 4})
    pick = lambda k: F.max(F.when(F.col("_line") == k, F.col("seq")))
    return lines.groupBy("_record").agg(F.substring(pick(0), 2, 1 << 30).alias("name"), pick(1).alias("seq"), pick(3).alias("quality")).drop("_record")


def write_lines(reads: DataFrame, path: str, order: Sequence[str] = ("read_id",)) -> None:
    """A text file of the sequences, a line each, in order over the files' names."""
    reads.repartitionByRange(*order).sortWithinPartitions(*order).select("seq").write.mode("overwrite").text(path)


def write_fasta(reads: DataFrame, path: str, width: int = 70) -> None:
    """FASTA records of reads(name, seq), lines of that width."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """FASTQ records of reads(name, seq, quality)."""
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "quality").alias("value")).write.mode("overwrite").text(path)


def write_read(reads: DataFrame, read_id: int, path: str) -> None:
    """A text file of one read."""
    reads.where(F.col("read_id") == read_id).select("seq").write.mode("overwrite").text(path)
