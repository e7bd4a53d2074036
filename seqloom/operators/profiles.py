"""Coverage profiles: in how many reads each k-mer of a read or pattern occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .kmers import extract

#: Counts of up to so many k-mers are broadcast to the reads.
BROADCAST_COUNTS = 1 << 19


def profile(patterns: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """patterns(read_id, seq) -> read_id, pos, kmer, q2, q4 for each of its k-mers; 0 where the
    collection has none. counts: what kmers.stats() gives of the collection. The counts are joined,
    one row for each k-mer, never the occurrences."""
    found = extract(patterns, k).join(counts, "kmer", "left")
    return found.select("read_id", "pos", "kmer", F.coalesce("q2", F.lit(0)).cast("long").alias("q2"), F.coalesce("q4", F.lit(0)).cast("long").alias("q4"))


def reverse_profile(patterns: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The profile of the patterns' reverse complements; positions are theirs."""
    return profile(patterns.withColumn("seq", reverse_complement(F.col("seq"))), counts, k)


def found_kmers(patterns: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The distinct k-mers of the patterns that the collection has."""
    return extract(patterns, k).select("kmer").distinct().join(counts, "kmer", "left_semi")


def absent_kmers(patterns: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The distinct k-mers of the patterns that the collection lacks."""
    return extract(patterns, k).select("kmer").distinct().join(counts, "kmer", "left_anti")


def own_summary(kmers: DataFrame) -> DataFrame:
    """summary() of the collection's reads against itself, of kmers(kmer, read_id, ...). Counts by
    k-mer and read serve for both: for the k-mers' reads, and weighted for the reads' k-mers."""
    each = kmers.groupBy("kmer", "read_id").agg(F.count(F.lit(1)).alias("n"))
    # With q4 both sides of the join need the same columns, so the counts are computed once.
    joined = each.join(each.groupBy("kmer").agg(F.count(F.lit(1)).alias("q2"), F.sum("n").alias("q4")), "kmer")
    return joined.groupBy("read_id").agg(F.sum("n").cast("long").alias("n_kmers"), F.sum(F.when(F.col("q4") > 0, F.col("n"))).cast("long").alias("n_found"), F.min("q2").alias("min_q2"), F.max("q2").alias("max_q2"), F.sum(F.col("q2") * F.col("n")).cast("long").alias("sum_q2"))


def whole_summary(reads: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """own_summary(extract(reads, k)) with counts, what kmers.stats() gives of the reads. While they are
    few they go to the reads, so no k-mer of a read is shuffled."""
    if counts.limit(BROADCAST_COUNTS + 1).count() > BROADCAST_COUNTS:
        return own_summary(extract(reads, k))
    return summary(extract(reads, k).join(F.broadcast(counts), "kmer"))


def summary(profiles: DataFrame) -> DataFrame:
    """A row per read: read_id, n_kmers, n_found, min_q2, max_q2, sum_q2."""
    return profiles.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_kmers"), F.count_if(F.col("q4") > 0).alias("n_found"), F.min("q2").alias("min_q2"), F.max("q2").alias("max_q2"), F.sum("q2").cast("long").alias("sum_q2"))
