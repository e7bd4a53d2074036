"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table: a start and a stride from
hashes of its name. The shards take turns, each claiming the first slot of its order that is still
free, until the table is full. A key's slot is its hash modulo the size, so placing a row is one
look into a broadcast table, loads differ by little, and when a shard comes or goes few other keys
move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Slots of the table, a prime. The broadcast table has as many rows, whatever the data's size.
SLOTS = 65_537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}\0{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The shard (its index) of each slot. weights: claims that a shard has in each turn, 1 each by default."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime and not below that of the shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be counts, one for each shard, not all 0")
    at = [_hash(x, "start") % slots for x in shards]
    stride = [_hash(x, "stride") % (slots - 1) + 1 if slots > 2 else 1 for x in shards]
    table, free = [-1] * slots, slots
    while free:
        for k, claims in enumerate(weights):
            for _ in range(min(claims, free)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % slots
                table[at[k]] = k
                free -= 1
    return table


def place(df: DataFrame, key: Column, shards: Sequence[str], *, slots: int = SLOTS, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with each row's slot and shard.

    Rows with equal keys go to one shard; a null key is a key like any other, so give a column
    that tells rows apart where nulls or one key may hold many rows. No row is shuffled. Columns
    named like slot_col or shard_col are replaced, all others stay.
    """
    table = fill_table(shards, slots, weights)
    slot, at, name = fresh(df, "shard_slot", "shard_at", "shard_name")
    rest = df.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).drop(slot_col, shard_col)
    lookup = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], f"{at} int, {name} string")
    out = rest.join(F.broadcast(lookup), F.col(slot) == F.col(at))
    return out.withColumnsRenamed({slot: slot_col, name: shard_col}).drop(at)
