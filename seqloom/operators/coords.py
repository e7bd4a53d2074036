"""Coordinates: text positions run over the reads one after another, with a terminator after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import Scratch, numbered

#: Numbers of reads up to this many are broadcast to leave the others out.
BROADCAST_READS = 1_000_000


def _size() -> Column:
    """A read's symbols; a null read is empty."""
    return F.coalesce(F.length("seq"), F.lit(0))


def with_starts(reads: DataFrame, scratch: Scratch, name: str = "starts") -> DataFrame:
    """reads(read_id, seq, ...) with start_pos, the text position of the read's first symbol, in
    the order of read_id. Null reads are empty."""
    sized = reads.withColumn("_length", (_size() + 1).cast("long"))
    found = numbered(sized, ["read_id"], scratch, name, "_number", ("_length", "_end"))
    return found.withColumn("start_pos", F.col("_end") - F.col("_length")).drop("_number", "_end", "_length")


def text_to_read(starts: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, text_pos) -> query_id, text_pos, read_id, pos.

    Reads and positions are cut into cells of the text; a read stands in each cell that it
    touches, so the lookup is an equality join. A terminator belongs to the read before it;
    positions outside the text find nothing.
    """
    cell = 1 << 16
    first, last = F.floor(F.col("start_pos") / cell), F.floor((F.col("start_pos") + _size()) / cell)
    spread = starts.select("read_id", "start_pos", _size().alias("_n"), F.explode(F.sequence(first, last)).alias("_cell"))
    asked = queries.withColumn("_cell", F.floor(F.col("text_pos") / cell))
    near = asked.join(spread, "_cell").where((F.col("text_pos") >= F.col("start_pos")) & (F.col("text_pos") <= F.col("start_pos") + F.col("_n")))
    return near.select("query_id", "text_pos", "read_id", (F.col("text_pos") - F.col("start_pos")).alias("pos"))


def read_to_text(starts: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, read_id, pos) with text_pos; positions beyond the terminator find nothing."""
    near = queries.join(starts.select("read_id", "start_pos", _size().alias("_n")), "read_id").where("pos BETWEEN 0 AND _n")
    return near.withColumn("text_pos", F.col("start_pos") + F.col("pos")).drop("start_pos", "_n")


def valid_positions(starts: DataFrame, k: int) -> DataFrame:
    """(read_id, first_pos, last_pos, n): the text positions at which a k-mer starts; null where none does."""
    n = F.greatest(_size() - k + 1, F.lit(0)).cast("long")
    some = F.when(n > 0, F.col("start_pos"))
    return starts.select("read_id", some.alias("first_pos"), (some + n - 1).alias("last_pos"), n.alias("n"))


def collection_size(reads: DataFrame) -> DataFrame:
    """One row: total_length (with terminators), n_reads, max_length (without)."""
    length = _size()
    return reads.agg(F.coalesce(F.sum(length + 1), F.lit(0)).cast("long").alias("total_length"), F.count(F.lit(1)).alias("n_reads"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_length"))


def read_lengths(reads: DataFrame) -> DataFrame:
    """(read_id, length) with the terminator."""
    return reads.select("read_id", (_size() + 1).cast("long").alias("length"))


def read_ranges(starts: DataFrame) -> DataFrame:
    """(read_id, first_pos, last_pos): the text positions of each read's symbols; null for empty reads."""
    some = F.when(_size() > 0, F.col("start_pos"))
    return starts.select("read_id", some.alias("first_pos"), (some + _size() - 1).alias("last_pos"))


def get_reads(reads: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(query_id, read_id) with seq, the read of that number; none if there isn't one. Reads that
    nothing asks for leave before the texts are shuffled, if those asked for are few enough."""
    ids = asked.select("read_id").distinct()
    few = ids.limit(BROADCAST_READS + 1).count() <= BROADCAST_READS
    near = reads.join(F.broadcast(ids), "read_id", "left_semi") if few else reads
    return asked.select("query_id", "read_id").join(near.select("read_id", "seq"), "read_id")
