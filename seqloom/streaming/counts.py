"""k-mer counts of a stream of reads.

k-mers don't span reads, so a read's distinct k-mers are found within its row and the number of
reads with a k-mer is a plain count: no distinct aggregation over the stream. The state is a row
per k-mer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cut
from ..operators.kmers import CHUNK, extract, positions


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, q2, q4) of a stream reads(read_id, seq), for the update or complete mode."""
    pieces = extract(reads.select("read_id", "seq"), k).select("kmer", F.lit(0).alias("q2"), F.lit(1).alias("q4"))
    # As in extract(), a read is cut into pieces first: the work is linear in its length.
    parts = F.transform(positions(F.ceil((F.length("seq") - (k - 1)) / CHUNK)), lambda x: cut(F.col("seq"), x * CHUNK, CHUNK + k - 1))
    each = F.flatten(F.transform(parts, lambda part: F.transform(positions(F.length(part) - (k - 1)), lambda i: cut(part, i, k))))
    once = reads.where(F.length("seq") >= k).select(F.explode(F.array_distinct(each)).alias("kmer"), F.lit(1).alias("q2"), F.lit(0).alias("q4"))
    return pieces.unionByName(once).groupBy("kmer").agg(F.sum("q2").cast("long").alias("q2"), F.sum("q4").cast("long").alias("q4"))


def into_table(counts: DataFrame, path: str, checkpoint: str, **trigger) -> None:
    """Run the stream until it has met all there is: each batch's changed rows go below path.

    A batch is written under its number, so one that is repeated replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def latest(deltas: DataFrame) -> DataFrame:
    """The last row of each k-mer."""
    return deltas.groupBy("kmer").agg(F.max_by(F.struct("q2", "q4"), "batch").alias("x")).select("kmer", "x.q2", "x.q4")
