"""Column functions over sequences; all positions are 0-based and count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that are mapped to bases, and the bases that they take in turn.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_dna(text: Column) -> Column:
    """Letters to bases in alphabet order modulo 4, all else to N."""
    return F.regexp_replace(F.translate(text, LETTERS, "ACGT" * 13), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """A and T, C and G swapped and the order reversed; any other symbol becomes N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGT]", "N")), "ACGT", "TGCA")


def cut(seq: Column, start: Column, length: Column | int) -> Column:
    """length symbols from position start on, or as many as there are."""
    return F.substring(seq, start + 1, length if isinstance(length, Column) else F.lit(length))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(first == 0, F.length(a)).otherwise(first - 1).cast("long")


def floor_log2(n: Column) -> Column:
    """The position of the highest bit that is set; null for numbers below 1."""
    return F.when(n >= 1, F.length(F.bin(n)) - 1).cast("long")


def ceil_log2(n: Column) -> Column:
    return F.when(n == 1, F.lit(0)).when(n > 1, floor_log2(n - 1) + 1).cast("long")


def bits(n: Column) -> Column:
    """Bits that are needed to write n; 1 for 0."""
    return F.when(n == 0, F.lit(1)).when(n > 0, floor_log2(n) + 1).cast("long")


def popcount(n: Column) -> Column:
    return F.bit_count(n).cast("long")
