"""The persisted k-mer index: tables reads, kmers and stats below a folder, and a description.

Collections are only ever added to: a merge renumbers the second one's reads and adds counts, an
append is a merge with new reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coords import collection_size, with_starts
from ..operators.kmers import extract, stats
from .scale import Scratch

VERSION = 17


@dataclass
class Index:
    """reads(read_id, seq, start_pos), kmers(kmer, read_id, pos), stats(kmer, q2, q4), and k."""

    reads: DataFrame
    kmers: DataFrame
    stats: DataFrame
    k: int

    def describe(self) -> DataFrame:
        size = collection_size(self.reads)
        return size.select(F.lit(VERSION).cast("long").alias("version"), F.lit(self.k).cast("long").alias("k"), "total_length", "n_reads", "max_length")


def build(reads: DataFrame, k: int, scratch: Scratch) -> Index:
    starts = with_starts(reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq")), scratch)
    found = extract(starts, k).select("kmer", "read_id", "pos")
    return Index(starts, found, stats(found), k)


def save(index: Index, path: str) -> None:
    """Write the tables and the description."""
    write_tables(index, path)
    index.describe().write.mode("overwrite").parquet(f"{path}/meta")


def write_tables(index: Index, path: str) -> None:
    """Write the tables, sorted by k-mer within ranges of it so that a lookup reads few files."""
    index.reads.write.mode("overwrite").parquet(f"{path}/reads")
    index.kmers.repartitionByRange("kmer", "read_id", "pos").sortWithinPartitions("kmer", "read_id", "pos").write.mode("overwrite").parquet(f"{path}/kmers")
    index.stats.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise ValueError(f"{path}: version {meta['version']}, not {VERSION}")
    return Index(*[spark.read.parquet(f"{path}/{x}") for x in ("reads", "kmers", "stats")], meta["k"])


def merge(first: Index, second: Index) -> Index:
    """Both collections as one: the second's reads follow the first's.

    A k-mer's counts are sums, as no read is in both; nothing is extracted again.
    """
    if first.k != second.k:
        raise ValueError("the indexes differ in k")
    size = first.reads.agg(F.coalesce(F.max("read_id") + 1, F.lit(0)), F.coalesce(F.max(F.col("start_pos") + F.length("seq") + 1), F.lit(0))).first()
    reads = first.reads.unionByName(second.reads.withColumns({"read_id": F.col("read_id") + size[0], "start_pos": F.col("start_pos") + size[1]}))
    kmers = first.kmers.unionByName(second.kmers.withColumn("read_id", F.col("read_id") + size[0]))
    counts = first.stats.unionByName(second.stats).groupBy("kmer").agg(F.sum("q2").cast("long").alias("q2"), F.sum("q4").cast("long").alias("q4"))
    return Index(reads, kmers, counts, first.k)


def append(index: Index, reads: DataFrame, scratch: Scratch) -> Index:
    """The index with new reads(seq, read_id from 0) after its own."""
    return merge(index, build(reads, index.k, scratch))
