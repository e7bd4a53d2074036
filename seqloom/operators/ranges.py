"""Range queries over a symbol sequence, many at once.

Each row of seq(i, c) is counted for its symbol and for the symbol without its last 4, 8, ... bits,
by position: a tree over the symbols whose nodes answer how often they occur before a position.
Queries go down that tree, so their work is that of the nodes that they meet, not of their rows.
Queries of up to NEAR rows meet these rows themselves, by blocks of positions.
Bounds are included on both ends; symbols are integers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import Scratch, lookup, numbered, scan
from .rankselect import symbol_ranks
from .ranktree import RankTree

#: Bits of a symbol that a level decides.
DIGIT = 4
#: Rows up to which a query meets them one by one, and rows of a block in which it does.
NEAR, BLOCK = 1_024, 256
#: Rows of a block in which symbols are searched for questions.
SEARCHED = 65_536


def _up(c: Column, level: int) -> Column:
    return F.shiftright(c, DIGIT * level)


class SymbolTree:
    def __init__(self, seq: DataFrame, scratch: Scratch, name: str = "symbols"):
        self.seq, self.scratch, self.name = seq, scratch, name

    @cached_property
    def least(self) -> int:
        return self._span[0]

    @cached_property
    def top(self) -> int:
        return -(-max(x.bit_length() for x in self._span) // DIGIT)

    @cached_property
    def _span(self) -> tuple[int, int]:
        found = self.seq.agg(F.coalesce(F.min("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
        return int(found[0]), int(found[1])

    @cached_property
    def tree(self) -> RankTree:
        levels = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), _up(F.col("c").cast("long"), k).alias("prefix")) for k in range(self.top + 1)]))
        rows = self.seq.select(F.col("i").cast("long").alias("at"), levels.alias("x")).select("x.of", "x.prefix", "at")
        return RankTree(rows, ["of", "prefix"], self.scratch, self.name)

    def _near(self, queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(query_id, i, c) of the queries of up to NEAR rows, and the other queries, if there are any."""
        far = queries.where(F.col("last") - F.col("first") >= NEAR)
        block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
        some = queries.where((F.col("last") - F.col("first")).between(0, NEAR - 1) & (F.col("least") <= F.col("most")))
        some = some.select("query_id", "first", "last", "least", "most", F.explode(F.sequence(block("first"), block("last"))).alias("_block"))
        met = some.hint("merge").join(self.seq.select(F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c"), block("i").alias("_block")), "_block")
        met = met.where(F.col("i").between(F.col("first"), F.col("last")) & F.col("c").between(F.col("least"), F.col("most")))
        return met.select("query_id", "i", "c"), None if far.isEmpty() else far

    def _counts(self, nodes: DataFrame, by: list[str]) -> DataFrame:
        """nodes(*by, of, prefix, first, last) with n, how many rows first to last have; none where 0."""
        ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("at")), F.struct(F.lit(1).alias("end"), (F.col("last") + 1).alias("at"))))
        keys = [*by, "of", "prefix"]
        asked = nodes.select(*keys, ends.alias("x")).select(*keys, "x.end", "x.at")
        ranks = self.tree.before(asked, [*keys, "end"])
        return ranks.groupBy(*keys).agg(F.sum(F.when(F.col("end") == 1, F.col("rank")).otherwise(-F.col("rank"))).alias("n")).where("n > 0")

    def _down(self, nodes: DataFrame, level: int) -> DataFrame:
        """The children, on level, that meet the queries' symbols."""
        digits = F.explode(F.sequence(F.lit(0), F.lit((1 << DIGIT) - 1)))
        each = nodes.withColumn("_digit", digits).withColumn("prefix", F.shiftleft("prefix", DIGIT) + F.col("_digit")).drop("_digit")
        return each.where(F.col("prefix").between(_up(F.col("least"), level), _up(F.col("most"), level))).withColumn("of", F.lit(level))

    def _roots(self, queries: DataFrame) -> DataFrame:
        asked = queries.where((F.col("first") <= F.col("last")) & (F.col("least") <= F.col("most")))
        bound = lambda c: F.greatest(F.least(F.col(c).cast("long"), F.lit((1 << (DIGIT * self.top)) - 1)), F.lit(-(1 << (DIGIT * self.top))))
        asked = asked.where((F.col("most") >= -(1 << (DIGIT * self.top))) & (F.col("least") < (1 << (DIGIT * self.top))))
        roots = F.explode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long")))
        each = asked.select("query_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), bound("least").alias("least"), bound("most").alias("most"), roots.alias("prefix"), F.lit(self.top).alias("of"))
        return each.where(F.col("prefix").between(_up(F.col("least"), self.top), _up(F.col("most"), self.top)))

    def distinct(self, queries: DataFrame, name: str = "distinct") -> DataFrame:
        """(query_id, c, n): the symbols least to most that rows first to last have, and how often.

        queries(query_id, first, last, least, most). Only nodes that occur in the rows are followed."""
        near, far = self._near(queries)
        found = near.groupBy("query_id", "c").agg(F.count(F.lit(1)).alias("n"))
        return found if far is None else found.unionByName(self._distinct(far, name))

    def _distinct(self, queries: DataFrame, name: str) -> DataFrame:
        nodes = self._roots(queries)
        bounds = queries.select("query_id", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "least", "most")])
        for level in range(self.top, -1, -1):
            if level < self.top:
                nodes = self._down(nodes, level)
            found = self.scratch.keep(self._counts(nodes, ["query_id"]), f"{name}-{level}")
            nodes = found.drop("n").join(bounds.hint("merge"), "query_id")
        return found.select("query_id", F.col("prefix").alias("c"), "n")

    def counts(self, queries: DataFrame, name: str = "counts") -> DataFrame:
        """(query_id, n): rows first to last with symbols least to most. Nodes whose symbols are all
        asked for are counted whole, so a query meets a few nodes of each level."""
        near, far = self._near(queries)
        found = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        found = found if far is None else found.unionByName(self._counts_down(far))
        return queries.select("query_id").join(found.hint("merge"), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def _counts_down(self, queries: DataFrame) -> DataFrame:
        nodes, whole = self._roots(queries), []
        for level in range(self.top, -1, -1):
            if level < self.top:
                nodes = self._down(nodes, level)
            inside = (F.shiftleft("prefix", DIGIT * level) >= F.col("least")) & (F.shiftleft(F.col("prefix") + 1, DIGIT * level) - 1 <= F.col("most"))
            whole.append(nodes.where(inside).select("query_id", "of", "prefix", "first", "last"))
            nodes = nodes.where(~inside)
        pieces = whole[0]
        for more in whole[1:]:
            pieces = pieces.unionByName(more)
        return self._counts(pieces, ["query_id"]).groupBy("query_id").agg(F.sum("n").alias("n"))

    def rows(self, queries: DataFrame, name: str = "rows") -> DataFrame:
        """(query_id, i, c): the rows themselves, by their ranks among those of the symbol."""
        near, far = self._near(queries)
        return near if far is None else near.unionByName(self._rows(far, name))

    def _rows(self, queries: DataFrame, name: str) -> DataFrame:
        found = self.scratch.keep(self._distinct(queries, f"{name}-distinct"), f"{name}-found")
        first = queries.select("query_id", F.col("first").cast("long").alias("at")).join(found, "query_id").select("query_id", F.lit(0).alias("of"), F.col("c").alias("prefix"), "at", "n")
        before = self.tree.before(first, ["query_id", "of", "prefix"]).select("query_id", F.col("prefix").alias("c"), F.col("rank").alias("_before"))
        places = found.join(before, ["query_id", "c"]).select("query_id", "c", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("n"))).alias("rank"))
        return places.join(symbol_ranks(self.seq).select(F.col("c").cast("long").alias("c"), "rank", "i"), ["c", "rank"]).select("query_id", "i", "c")

    def rank_less_than(self, queries: DataFrame, name: str = "less") -> DataFrame:
        """(query_id, symbol, rank) of queries(query_id, c, i): the largest symbol up to c that occurs
        up to i, and how often it does; null and -1 if there is none.

        That is the last symbol up to c whose first place is no later than i: symbols with their first places
        and questions are sorted together once, by symbol, and met in blocks of SEARCHED rows. What a block
        doesn't answer is looked up in the nearest one before it that does. Rows after all i's are left out."""
        seq = self.seq.select(F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c"))
        asked = queries.select(F.col("c").cast("long").alias("c"), F.col("i").cast("long").alias("i")).where("c IS NOT NULL AND i IS NOT NULL").distinct()  # equal questions are asked once
        asked = self.scratch.keep(asked, f"{name}-asked")
        last = asked.agg(F.max("i")).first()[0]
        seq = seq.where(F.col("c").isNotNull() & (F.col("i") <= F.lit(last)))
        firsts = seq.groupBy("c").agg(F.min("i").alias("i"))
        both = firsts.select("c", F.lit(0).alias("kind"), "i").unionByName(asked.select("c", F.lit(1).alias("kind"), "i"))
        placed = numbered(both, ["c", "kind", "i"], self.scratch, f"{name}-order", "_n").withColumn("block", F.floor(F.col("_n") / SEARCHED).cast("long"))
        earliest = placed.where("kind = 0").groupBy("block").agg(F.min("i")).collect()  # a row for each block
        blocks = np.full(max((x[0] for x in earliest), default=-1) + 1, np.iinfo(np.int64).max)
        for block, i in earliest:
            blocks[block] = i
        dealt = placed.repartition("block").sortWithinPartitions("block", "_n").select("block", "kind", "c", "i")
        met = self.scratch.keep(dealt.mapInArrow(_searched(blocks), "kind int, c long, i long, symbol long, block long"), f"{name}-met")
        open_ = met.where("kind = 1").select("c", "i", "block")
        # In a block the last symbol that is early enough is that of the latest of its steps up to i.
        steps = met.where("kind = 2").select("block", "i", F.lit(0).alias("_kind"), "symbol", F.lit(0).cast("long").alias("_rows"))
        sought = open_.groupBy("block", "i").agg(F.count(F.lit(1)).alias("_rows")).select("block", "i", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("symbol"), "_rows")
        order = numbered(steps.unionByName(sought), ["block", "i", "_kind"], self.scratch, f"{name}-steps", "_n")
        told = self.scratch.keep(scan(order, "_n", symbol=("last", F.col("symbol"))).where("_kind = 1").select("block", "i", "symbol", "_rows"), f"{name}-told")
        found = met.where("kind = 0").select("c", "i", "symbol").unionByName(lookup(open_, told, ["block", "i"], "_rows").select("c", "i", "symbol"))
        found = self.scratch.keep(found, f"{name}-found")
        pairs = self.scratch.keep(found.groupBy("symbol", "i").agg(F.count(F.lit(1)).alias("_rows")), f"{name}-pairs")
        tree = RankTree(seq.select(F.col("c").alias("symbol"), F.col("i").alias("at")), ["symbol"], self.scratch, f"{name}-places")
        ranks = tree.before(pairs.select("symbol", "i", (F.col("i") + 1).alias("at")), ["symbol", "i"])
        ranks = self.scratch.keep(pairs.join(ranks.hint("merge"), ["symbol", "i"]), f"{name}-ranks")
        answers = lookup(found, ranks, ["symbol", "i"], "_rows")
        return queries.select("query_id", "c", "i").join(answers.hint("merge"), ["c", "i"], "left").select("query_id", "symbol", F.coalesce("rank", F.lit(-1)).alias("rank"))


def _searched(blocks: np.ndarray):
    """A function for mapInArrow over (block, kind, c, i), sorted by symbol within blocks: kind 0 are symbols with
    their first places, kind 1 questions. It gives questions with their symbol (kind 0) or with the nearest
    block before that has one (kind 1), none for those that have no answer, and each block's steps (kind 2): its
    symbols that come first earlier than all larger ones. blocks has the earliest place in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, symbols = None, [], []
        before = np.zeros(0, np.int64)  # the earliest places from the last block before this one on, turned so as to ascend

        def steps() -> pa.RecordBatch:
            n = len(places)
            return batch_of([2] * n, symbols, places, symbols, [at] * n)

        def batch_of(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [pa.int32(), *[pa.int64()] * 4])], ["kind", "c", "i", "symbol", "block"])

        for batch in batches:
            out: list[tuple] = []
            for block, kind, c, i in zip(*[x.to_pylist() for x in batch.columns]):
                if block != at:
                    if places:
                        yield steps()
                    at, places, symbols = block, [], []
                    before = -np.minimum.accumulate(blocks[:block][::-1])
                if not kind:
                    k = bisect_left(places, i)  # those that come no earlier give way to a larger symbol
                    places[k:], symbols[k:] = [i], [c]
                    continue
                k = bisect_right(places, i)
                if k:
                    out.append((0, c, i, symbols[k - 1], None))
                    continue
                back = int(np.searchsorted(before, -i))
                if back < len(before):
                    out.append((1, c, i, None, len(before) - 1 - back))
            if out:
                yield batch_of(*map(list, zip(*out)))
        if places:
            yield steps()

    return run
