"""Suffix order of a read collection, and what derives from it.

Rows are the suffixes of all reads with the empty one that a terminator starts. Terminators are
distinct, ordered by read and below all symbols, so suffixes are ordered by their text and equal
ones by read. Numbers of terminator rows are 0 to reads - 1; the numbering without them starts
after those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import common_prefix, cut
from ..plans.scale import Scratch, numbered, running_sum, scan
from .kmers import extract, positions, read_stats

#: Symbols of the first sort key of prefix doubling.
FIRST = 16


def suffixes(reads: DataFrame) -> DataFrame:
    """(read_id, pos, suffix), the empty suffix included. The texts add up to the square of a
    read's length: for short reads."""
    rows = reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq"))
    rows = rows.select("read_id", "seq", F.explode(positions(F.length("seq") + 1)).alias("pos"))
    return rows.select("read_id", F.col("pos").cast("long").alias("pos"), F.substring(F.col("seq"), F.col("pos") + 1, F.length("seq")).alias("suffix"))


def suffix_order(reads: DataFrame, scratch: Scratch, name: str = "suffixes") -> DataFrame:
    """(sa_idx, read_id, pos, suffix) in suffix order: one sort by ranges."""
    return numbered(suffixes(reads), ["suffix", "read_id"], scratch, name, "sa_idx")


def prefix_ranks(reads: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(read_id, pos, key) with each suffix's first FIRST symbols, and a list of widths with
    (read_id, pos, left, rank), the ranks of the suffixes cut to that many symbols; left is how many they have.

    A round joins each suffix's rank with that of the suffix as many symbols further on, and
    numbers the distinct pairs; rows stay a few numbers wide. It ends when each rank is one
    suffix's alone, or when the prefixes are longer than every read.
    """
    rows = reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq"))
    longest = rows.agg(F.max(F.length("seq"))).first()[0] or 0
    cells = rows.select("read_id", "seq", F.explode(positions(F.ceil((F.length("seq") + 1) / 256))).alias("_cell"))
    cells = cells.select("read_id", (F.col("_cell") * 256).alias("_base"), F.length("seq").alias("_n"), cut(F.col("seq"), F.col("_cell") * 256, 256 + FIRST - 1).alias("_text"))
    each = cells.select("read_id", "_base", "_n", "_text", F.explode(positions(F.least(F.lit(256), F.col("_n") + 1 - F.col("_base")))).alias("_at"))
    texts = ranks = scratch.keep(each.select("read_id", (F.col("_base") + F.col("_at")).cast("long").alias("pos"), (F.col("_n") - F.col("_base") - F.col("_at")).cast("long").alias("left"), cut(F.col("_text"), F.col("_at"), FIRST).alias("key")), "keys-0")
    keys, width, levels = ["key"], FIRST, []
    while True:
        turn = len(levels)
        if turn:
            ranks = scratch.keep(ranks, f"keys-{turn}")
        distinct = numbered(ranks.select(*keys).distinct(), keys, scratch, f"ranks-{turn}", "rank")
        ranks = scratch.keep(ranks.join(distinct, keys).select("read_id", "pos", "left", "rank"), f"ranked-{turn}")
        levels.append((width, ranks))
        if width > longest or distinct.count() == ranks.count():
            return texts, levels
        ahead = ranks.select("read_id", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        ranks = ranks.join(ahead, ["read_id", "pos"], "left").select("read_id", "pos", "left", F.col("rank").alias("own"), F.coalesce("next", F.lit(-1)).alias("next"))
        keys, width = ["own", "next"], width * 2


def suffix_order_doubling(reads: DataFrame, scratch: Scratch) -> DataFrame:
    """(sa_idx, read_id, pos) for reads of any length: ranks of prefixes that double in length."""
    _, levels = prefix_ranks(reads, scratch)
    return numbered(levels[-1][1], ["rank", "read_id"], scratch, "order", "sa_idx").select("sa_idx", "read_id", "pos")


def lcp_doubling(reads: DataFrame, scratch: Scratch) -> DataFrame:
    """(sa_idx, read_id, pos, lcp) as lcp() has it, for reads of any length.

    From the widest prefixes down, neighbours whose ranks agree where they have come to go on by
    the width, or to the reads' end; what is left is shorter than FIRST and compared as text. Those
    that have come to the read's end, as copies do, are joined with nothing more.
    """
    texts, levels = prefix_ranks(reads, scratch)
    widest, ranks = levels[-1]
    order = numbered(ranks, ["rank", "read_id"], scratch, "order", "sa_idx").select("sa_idx", "read_id", "pos", "left", "rank")
    before = order.select((F.col("sa_idx") + 1).alias("sa_idx"), F.col("read_id").alias("_read"), F.col("pos").alias("_pos"), F.col("rank").alias("_before"))
    same = F.when(F.col("rank") == F.col("_before"), F.least(F.lit(widest), F.col("left"))).otherwise(0)
    pairs = order.join(before.hint("merge"), "sa_idx", "left").withColumn("lcp", same.cast("long")).drop("rank", "_before")
    pairs, going = scratch.keep(pairs, f"lcp-{widest}"), F.col("_read").isNotNull() & (F.col("lcp") < F.col("left"))

    def meet(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """pairs with both suffixes' values where they have come to, as _a and _b."""
        placed = pairs.withColumns({"_at": F.col("pos") + F.col("lcp"), "_other": F.col("_pos") + F.col("lcp")})
        own = values.select("read_id", F.col("pos").alias("_at"), F.col(value).alias("_a"))
        other = values.select(F.col("read_id").alias("_read"), F.col("pos").alias("_other"), F.col(value).alias("_b"))
        return placed.join(own.hint("merge"), ["read_id", "_at"], "left").join(other.hint("merge"), ["_read", "_other"], "left")

    for width, ranks in reversed(levels[:-1]):
        further = F.when(F.col("_a") == F.col("_b"), F.least(F.lit(width), F.col("left") - F.col("lcp"))).otherwise(0)
        moved = meet(pairs.where(going), ranks, "rank").withColumn("lcp", (F.col("lcp") + further).cast("long")).select(*pairs.columns)
        pairs = scratch.keep(moved.unionByName(pairs.where(~going)), f"lcp-{width}")
    rest = F.coalesce(common_prefix(F.col("_a"), F.col("_b")), F.lit(0))
    last = meet(pairs.where(going), texts, "key").withColumn("lcp", (F.col("lcp") + rest).cast("long")).select(*pairs.columns)
    return last.unionByName(pairs.where(~going)).select("sa_idx", "read_id", "pos", "lcp")


def bwt(order: DataFrame, reads: DataFrame) -> DataFrame:
    """(sa_idx, symbol): what stands before each suffix, null (a terminator) before a read's first."""
    symbols = extract(reads, 1).select("read_id", (F.col("pos") + 1).alias("pos"), F.col("kmer").alias("symbol"))
    # Sizes are estimated from the reads' file, which knows nothing of a row for each symbol.
    joined = order.select("sa_idx", "read_id", "pos").join(symbols.hint("merge"), ["read_id", "pos"], "left")
    return joined.select("sa_idx", "symbol")


def bwt_runs(transform: DataFrame) -> DataFrame:
    """One row: n_runs of equal symbols, those of terminators left out. Neighbours are met by their number."""
    before = transform.select((F.col("sa_idx") + 1).alias("sa_idx"), F.col("symbol").alias("_before"))
    joined = transform.where(F.col("symbol").isNotNull()).join(before, "sa_idx", "left")
    return joined.agg(F.count_if(~F.col("_before").eqNullSafe(F.col("symbol"))).alias("n_runs"))


def symbol_starts(transform: DataFrame) -> DataFrame:
    """(symbol, n, first): how often each symbol occurs, and how many smaller ones there are. Terminators,
    the null symbol, are below all others."""
    counts = transform.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    # A row for each code point that occurs meets in one task: 1,114,112 at most.
    order = Window.orderBy(F.col("symbol").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("symbol", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("first"))


def psi(order: DataFrame) -> DataFrame:
    """(sa_idx, psi): the row of the suffix one symbol shorter; null for terminators."""
    ahead = order.select("read_id", (F.col("pos") - 1).alias("pos"), F.col("sa_idx").alias("psi"))
    return order.select("sa_idx", "read_id", "pos").join(ahead, ["read_id", "pos"], "left").select("sa_idx", "psi")


def last_to_first(transform: DataFrame) -> DataFrame:
    """(sa_idx, symbol, lf) of the rows that a symbol stands before: the row of the suffix one
    symbol longer, its first row number plus the symbol's rank."""
    ranks = running_sum(transform.where(F.col("symbol").isNotNull()), F.lit(1).cast("long"), "sa_idx", "_rank", keys=["symbol"])
    return ranks.join(F.broadcast(symbol_starts(transform)), "symbol").select("sa_idx", "symbol", (F.col("first") + F.col("_rank") - 1).alias("lf"))  # a row for each code point


def lcp(order: DataFrame) -> DataFrame:
    """(sa_idx, read_id, pos, lcp): the common prefix with the suffix before; 0 for the first.
    Terminators are distinct, so they end it."""
    before = order.select((F.col("sa_idx") + 1).alias("sa_idx"), F.col("suffix").alias("_before"))
    joined = order.join(before, "sa_idx", "left")
    return joined.select("sa_idx", "read_id", "pos", F.coalesce(common_prefix(F.col("suffix"), F.col("_before")), F.lit(0)).alias("lcp"))


def plcp(lcps: DataFrame, starts: DataFrame) -> DataFrame:
    """(text_pos, plcp): the same values by text position."""
    return lcps.join(starts.select("read_id", "start_pos").hint("merge"), "read_id").select((F.col("start_pos") + F.col("pos")).alias("text_pos"), F.col("lcp").alias("plcp"))


def lcp_samples(lcps: DataFrame, rate: int) -> DataFrame:
    """The rows whose number is a multiple of rate."""
    return lcps.where(F.col("sa_idx") % rate == 0).select("sa_idx", "lcp")


def plcp_samples(values: DataFrame) -> DataFrame:
    """The rows of values(text_pos, plcp) that the others follow from: those that aren't the value
    before minus 1, as common prefixes in text order shrink by at most a symbol."""
    before = values.select((F.col("text_pos") + 1).alias("text_pos"), F.col("plcp").alias("_before"))
    joined = values.join(before, "text_pos", "left")
    return joined.where(~F.coalesce(F.col("plcp") == F.col("_before") - 1, F.lit(False))).select("text_pos", "plcp")


def plcp_from_samples(samples: DataFrame, places: DataFrame) -> DataFrame:
    """(text_pos, plcp) of places(text_pos), dense from 0: the last sample up to each, less the way from it."""
    marked = places.select("text_pos").join(samples.select("text_pos", (F.col("text_pos") + F.col("plcp")).alias("_reach")), "text_pos", "left")
    return scan(marked, "text_pos", _last=("last", F.col("_reach"))).select("text_pos", (F.col("_last") - F.col("text_pos")).alias("plcp"))


def insertion_ranks_doubling(reads: DataFrame, others: DataFrame, scratch: Scratch) -> DataFrame:
    """insertion_ranks() for reads of any length: ranks of prefixes that double over both collections together."""
    both = reads.select((F.col("read_id") * 2).alias("read_id"), "seq").unionByName(others.select((F.col("read_id") * 2 + 1).alias("read_id"), "seq"))
    _, levels = prefix_ranks(both, scratch)
    new = F.pmod("read_id", F.lit(2))
    each = levels[-1][1].select("rank", new.alias("_new"), ((F.col("read_id") - new) / 2).cast("long").alias("read_id"), "pos", (F.lit(1) - new).cast("long").alias("_own")).withColumnRenamed("rank", "_rank")
    found = numbered(each, ["_rank", "_new", "read_id"], scratch, "insertion", "_number", ("_own", "rank"))
    return found.where("_new = 1").select("read_id", "pos", "rank")


def merge_orders(first: DataFrame, second: DataFrame, ranks: DataFrame) -> DataFrame:
    """(sa_idx, second, read_id, pos): two suffix orders (sa_idx, read_id, pos) as one, the first's
    suffixes before equal ones of the second. ranks(read_id, pos, rank): where the second's go.

    A row of the second moves by its rank, one of the first by the second's rows up to it.
    """
    own = second.join(ranks, ["read_id", "pos"]).select((F.col("sa_idx") + F.col("rank")).alias("sa_idx"), F.lit(True).alias("second"), "read_id", "pos")
    here = ranks.groupBy(F.col("rank").alias("sa_idx")).agg(F.count(F.lit(1)).alias("_n"))
    moved = running_sum(first.select("sa_idx", "read_id", "pos").join(here, "sa_idx", "left"), F.coalesce("_n", F.lit(0)), "sa_idx", "_by")
    return moved.select((F.col("sa_idx") + F.col("_by")).alias("sa_idx"), F.lit(False).alias("second"), "read_id", "pos").unionByName(own)


def insertion_ranks(order: DataFrame, others: DataFrame, scratch: Scratch) -> DataFrame:
    """(read_id, pos, rank): for each suffix of other reads how many of order's rows are before
    it; equal suffixes of the collection come first."""
    base = order.select("suffix", F.lit(0).alias("_new"), "read_id", "pos")
    both = base.unionByName(suffixes(others).select("suffix", F.lit(1).alias("_new"), "read_id", "pos")).withColumn("_own", (F.lit(1) - F.col("_new")).cast("long"))
    found = numbered(both, ["suffix", "_new", "read_id", "pos"], scratch, "insertion", "_number", ("_own", "rank"))
    return found.where("_new = 1").select("read_id", "pos", "rank")


def kmer_ranges(reads: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(kmer, sp, ep): the rows of the suffix order that start with each k-mer, both ends included.

    Suffixes cut to k symbols, short ones and terminators included, are counted by text and added
    up in order; no suffix is sorted by itself.
    """
    text = F.coalesce("seq", F.lit(""))
    ends = reads.select(F.explode(F.transform(positions(F.least(F.lit(k), F.length(text) + 1)), lambda n: F.right(text, n))).alias("kmer"))
    counts = ends.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).unionByName(read_stats(reads, k).select("kmer", F.col("q4").alias("n")))
    found = numbered(counts, ["kmer"], scratch, "ranges", "_number", ("n", "_end"))
    return found.where(F.length("kmer") == k).select("kmer", (F.col("_end") - F.col("n")).cast("long").alias("sp"), (F.col("_end") - 1).cast("long").alias("ep"))
