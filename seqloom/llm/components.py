"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of links(a, b); root is the least node that is reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least node it
    knows; rounds grow as the logarithm of the longest chain. A node's least neighbour is found by
    an aggregation that is partial before the shuffle, and both sides of each join are read from
    written tables, so a hub's rows can be split among tasks. Loops and repeated links are
    ignored; nodes without another to link to aren't in the result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.keep(edges, "edges-0")
    state, turn = _state(edges), 0
    while state[0]:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least-{turn}")
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{turn}")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"lower-{turn}")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges-{turn}")
        now = _state(after)
        for name in ("least", "large", "lower"):
            scratch.drop(f"{name}-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        edges, before, state = after, state, now
        if now == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch.keep(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; differs otherwise, but for a chance of 2^-64."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


class Links:
    """Union-find over the rows of one task, fed with many links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        """The root of each row."""
        found = self.parent[at]
        while True:
            further = self.parent[found]
            if (further == found).all():
                break
            found = further
        self.parent[at] = found
        return found

    def join(self, at: np.ndarray) -> None:
        """Put rows into one component."""
        found = self.roots(at)
        self.parent[found] = found.min()
        self.parent[at] = found.min()
