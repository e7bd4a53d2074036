"""Permutations, alphabet maps and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import Scratch, numbered


def invert(permutation: DataFrame) -> DataFrame:
    """permutation(i, pi) -> (i, rev_pi)."""
    return permutation.select(F.col("pi").alias("i"), F.col("i").alias("rev_pi"))


def dense_alphabet(seq: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, mapped): symbols that occur, numbered from 1 in order."""
    found = numbered(seq.select("c").where("c IS NOT NULL").distinct(), ["c"], scratch, "alphabet", "_number")
    return found.select("c", (F.col("_number") + 1).cast("long").alias("mapped"))


def gaps(ones: DataFrame, scratch: Scratch) -> DataFrame:
    """ones(i) with gap, the distance to the one before; i + 1 for the first."""
    order = numbered(ones, ["i"], scratch, "gaps", "_number")
    before = order.select((F.col("_number") + 1).alias("_number"), F.col("i").alias("_before"))
    return order.join(before, "_number", "left").select("i", (F.col("i") - F.coalesce("_before", F.lit(-1))).alias("gap"))
