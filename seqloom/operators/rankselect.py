"""Rank, select and range operators over bits(i, b) and symbol sequences seq(i, c).

Indices are dense from 0. Ranks count up to and with a position; select counts from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import running_sum, scan


def bit_ranks(bits: DataFrame) -> DataFrame:
    """bits with rank1 and rank0."""
    ones = running_sum(bits, F.col("b").cast("long"), "i", "rank1")
    return ones.withColumn("rank0", F.col("i") + 1 - F.col("rank1"))


def bit_select(bits: DataFrame) -> DataFrame:
    """(b, j, i): where the j-th one and the j-th zero stand, j from 1."""
    ranks = bit_ranks(bits)
    return ranks.select("b", F.when(F.col("b"), F.col("rank1")).otherwise(F.col("rank0")).alias("j"), "i")


def bit_neighbours(bits: DataFrame) -> DataFrame:
    """bits with prev1 (last one up to i), next1 (first one from i on; the length if there is
    none), select_next1 and select_next0 (first one and zero strictly after i; null if none)."""
    one, zero = F.when(F.col("b"), F.col("i")), F.when(~F.col("b"), F.col("i"))
    found = scan(bits, "i", prev1=("last", one), next1=("first", one), select_next1=("after", one), select_next0=("after", zero))
    n = bits.agg(F.count(F.lit(1)).alias("_n"))
    return found.join(F.broadcast(n)).withColumn("next1", F.coalesce("next1", "_n")).drop("_n")  # n is one row


def bit_counts(bits: DataFrame) -> DataFrame:
    """One row: length, n_ones, n_zeros."""
    return bits.agg(F.count(F.lit(1)).alias("length"), F.count_if("b").alias("n_ones"), F.count_if(~F.col("b")).alias("n_zeros"))


def vector_ranks(bits: DataFrame) -> DataFrame:
    """(i, rank, at_least): ones up to i, and ones before i plus 1."""
    return bit_ranks(bits).select("i", F.col("rank1").alias("rank"), (F.col("rank1") - F.col("b").cast("long") + 1).alias("at_least"))


def vector_select(bits: DataFrame) -> DataFrame:
    """(idx, i, next_i): the ones numbered from 0, and the next one's place."""
    ones = bit_ranks(bits).where("b").select((F.col("rank1") - 1).alias("idx"), "i")
    return scan(ones, "idx", next_i=("after", F.col("i")))


def value_after(bits: DataFrame) -> DataFrame:
    """(v, i, idx) for each position v: the first one from v on and its number from 0; the length
    and the number of ones if there is none."""
    ranked = scan(bits, "i", _next=("first", F.when(F.col("b"), F.col("i"))), rank1=("sum", F.col("b").cast("long")))
    total = bits.agg(F.count(F.lit(1)).alias("_n"))
    idx = F.col("rank1") - F.col("b").cast("long")
    return ranked.join(F.broadcast(total)).select(F.col("i").alias("v"), F.coalesce("_next", "_n").alias("i"), idx.alias("idx"))  # total is one row


def bit_runs(bits: DataFrame) -> DataFrame:
    """(start, length) of the runs of ones."""
    ones = bit_ranks(bits).where("b").withColumn("_run", F.col("i") - F.col("rank1"))
    return ones.groupBy("_run").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def access(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(query_id, i) with the row of rows(i, ...) at each position; none beyond the end."""
    return asked.select("query_id", "i").join(rows, "i")


def merge_vectors(first: DataFrame, second: DataFrame, inserted: DataFrame) -> DataFrame:
    """(i): the ones of two vectors once second is inserted into first.

    first(i) and second(i) are the ones; inserted(j, before) says of each position j of second
    before which position of first it comes, ascending. A position moves by what is inserted
    before it: those of second by their place, those of first by the insertions up to them.
    """
    placed = second.join(inserted.withColumnRenamed("j", "i"), "i").select((F.col("before") + F.col("i")).alias("i"))
    marks = first.select(F.col("i").alias("at"), F.lit(0).alias("n"), F.lit(True).alias("own")).unionByName(inserted.select(F.col("before").alias("at"), F.lit(1).alias("n"), F.lit(False).alias("own")))
    each = marks.groupBy("at").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    moved = running_sum(each, F.col("n"), "at", "_shift").where("own").select((F.col("at") + F.col("_shift")).alias("i"))
    return moved.unionByName(placed)


def symbol_ranks(seq: DataFrame) -> DataFrame:
    """seq with rank: how often c occurs up to i. Also select: the row with c and rank j has i."""
    return running_sum(seq, F.lit(1).cast("long"), "i", "rank", keys=["c"])


def select_next(seq: DataFrame) -> DataFrame:
    """seq with next_i, the next place of the same symbol strictly after i."""
    return scan(seq, "i", ["c"], next_i=("after", F.col("i")))


def symbol_counts(seq: DataFrame) -> DataFrame:
    return seq.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def rank_in(seq: DataFrame, queries: Sequence[tuple[int, int]]) -> DataFrame:
    """(c, i, rank) for each (c, i), in one pass; 0 for a symbol that there isn't."""
    names = [F.count_if((F.col("c") == c) & (F.col("i") <= i)).alias(f"q{k}") for k, (c, i) in enumerate(queries)]
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), F.lit(i).cast("long").alias("i"), F.col(f"q{k}").alias("rank")) for k, (c, i) in enumerate(queries)])
    return seq.agg(*names).select(F.inline(rows))


def rank_less_than(seq: DataFrame, queries: Sequence[tuple[int, int]]) -> DataFrame:
    """(c, i, symbol, rank) for each (c, i): the largest symbol up to c that occurs up to i, and
    its rank; null and -1 if there is none. One pass gives a row for each symbol."""
    counts = seq.groupBy("c").agg(*[F.count_if(F.col("i") <= i).alias(f"q{k}") for k, (_, i) in enumerate(queries)])
    hit = [F.max(F.when((F.col("c") <= c) & (F.col(f"q{k}") > 0), F.struct(F.col("c").cast("long").alias("symbol"), F.col(f"q{k}").alias("rank")))).alias(f"h{k}") for k, (c, _) in enumerate(queries)]
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), F.lit(i).cast("long").alias("i"), F.col(f"h{k}.symbol").alias("symbol"), F.coalesce(F.col(f"h{k}.rank"), F.lit(-1)).alias("rank")) for k, (c, i) in enumerate(queries)])
    return counts.agg(*hit).select(F.inline(rows))


def in_range(seq: DataFrame, first: int, last: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """The rows at first to last with symbols least to most, all bounds included."""
    rows = seq.where(F.col("i").between(first, last))
    rows = rows if least is None else rows.where(F.col("c") >= least)
    return rows if most is None else rows.where(F.col("c") <= most)


def distinct_in_range(seq: DataFrame, first: int, last: int, least: int | None = None, most: int | None = None) -> DataFrame:
    return in_range(seq, first, last, least, most).select("c").distinct()


def counts_in_range(seq: DataFrame, first: int, last: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """One row: n_distinct, and n_rows as a bag."""
    return in_range(seq, first, last, least, most).agg(F.countDistinct("c").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))
