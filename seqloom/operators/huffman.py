"""Canonical Huffman codes of a symbol sequence, and sequences packed by them in blocks.

Only how many symbols occur equally often matters for the lengths of codes, so the driver builds the
tree from runs of equal counts. With n rows there are at most sqrt(2 n) different counts, whatever
the alphabet; its symbols stay a table.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import Scratch, lookup, numbered, running_sum

#: Symbols of a block.
BLOCK = 4_096


def run_lengths(runs: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """runs: count -> symbols that occur so often. For each count its code lengths, ascending, with
    how many of the symbols have each. A single symbol has one bit.

    Of the least weight all nodes are paired at once; one that is left goes with the next weight.
    """
    if not runs:
        return {}
    if len(runs) == 1 and 1 in runs.values():
        return {next(iter(runs)): [(1, 1)]}
    weights, heap = list(runs), [(w, k, runs[w]) for k, w in enumerate(runs)]
    heapq.heapify(heap)
    above: list[list[tuple[int, int]]] = [[] for _ in weights]  # of each run: the run above, and nodes of this one below each of its nodes
    while True:
        weight, k, many = heapq.heappop(heap)
        if many == 1 and not heap:
            break
        new = len(above)
        above.append([])
        if many > 1:
            above[k].append((new, 2))
            heapq.heappush(heap, (2 * weight, new, many // 2))
            if many % 2:
                heapq.heappush(heap, (weight, k, 1))
        else:
            other, j, rest = heapq.heappop(heap)
            above[k].append((new, 1))
            above[j].append((new, 1))
            heapq.heappush(heap, (weight + other, new, 1))
            if rest > 1:
                heapq.heappush(heap, (other, j, rest - 1))
    depths: list[dict[int, int]] = [defaultdict(int) for _ in above]
    depths[-1][0] = 1
    for k in range(len(above) - 1, -1, -1):
        for up, each in above[k]:
            for depth, many in depths[up].items():
                depths[k][depth + 1] += each * many
    return {w: sorted(depths[k].items()) for k, w in enumerate(weights)}


def code_table(seq: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, n, length, code, place) of seq(i, c): how often each symbol occurs, its canonical code and
    its place in the order of lengths and symbols. Null symbols have no code."""
    counts = scratch.keep(seq.where(F.col("c").isNotNull()).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "huffman-counts")
    runs = {x["n"]: x["m"] for x in counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}  # a row for each different count
    lengths = run_lengths(runs)
    spans, before, each = [], 0, defaultdict(int)
    for n in sorted(runs):
        for length, many in lengths[n]:
            spans.append((n, before, before + many, length))
            each[length] += many
            before += many
    spark = seq.sparkSession
    order = numbered(counts, ["n", "c"], scratch, "huffman-order", "_nth")
    named = F.broadcast(spark.createDataFrame(spans, "n long, _from long, _to long, length int"))  # a few rows for each different count
    coded = order.join(named, "n").where((F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))).select("c", "n", "length")
    firsts, code, place, last = [], 0, 0, 0
    for length in sorted(each):
        code <<= length - last
        firsts.append((length, code, place))
        code, place, last = code + each[length], place + each[length], length
    placed = numbered(coded, ["length", "c"], scratch, "huffman-places", "place")
    table = placed.join(F.broadcast(spark.createDataFrame(firsts, "length int, _code long, _place long")), "length")  # a row for each length
    return scratch.keep(table.select("c", "n", "length", (F.col("_code") + F.col("place") - F.col("_place")).alias("code"), "place"), "huffman-codes")


def size(codes: DataFrame) -> DataFrame:
    """One row: n, n_symbols, total_bits."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return codes.agg(total("n").alias("n"), F.count(F.lit(1)).alias("n_symbols"), total(F.col("n") * F.col("length")).alias("total_bits"))


def encode(seq: DataFrame, codes: DataFrame) -> DataFrame:
    """(block, n, bits, offset, data) of seq(i, c), i dense from 0: each BLOCK symbols' codes as bytes,
    the last one filled with zeros; bits of them, and of all blocks before."""
    coded = codes.select("c", "n", F.lpad(F.bin("code"), F.col("length"), F.lit("0")).alias("bits"))
    each = lookup(seq.select("i", "c"), coded, ["c"], "n")
    blocks = each.groupBy(F.floor(F.col("i") / BLOCK).alias("block")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"]), "").alias("text"))
    filled = F.concat("text", F.repeat(F.lit("0"), F.pmod(-F.length("text"), F.lit(8)).cast("int")))
    data = F.unhex(F.array_join(F.transform(F.regexp_extract_all(filled, F.lit("[01]{8}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))
    packed = blocks.select("block", "n", F.length("text").cast("long").alias("bits"), data.alias("data"))
    return running_sum(packed, F.col("bits"), "block", "_end").select("block", "n", "bits", (F.col("_end") - F.col("bits")).alias("offset"), "data")


def decode(blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """(i, c) again. A task needs the first code of each length, not the alphabet."""
    firsts = sorted((x["length"], x["code"], x["place"]) for x in codes.groupBy("length").agg(F.min("code").alias("code"), F.min("place").alias("place")).collect())  # a row for each length
    length, first, place = (np.array(x, dtype=np.int64) for x in (zip(*firsts) if firsts else ((), (), ())))
    longest, per_block = int(length.max(initial=0)), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, bits, data in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "bits", "data")]):
                # The window of the longest code's bits at each bit tells the code that would start there.
                one = np.concatenate([np.unpackbits(np.frombuffer(data, dtype=np.uint8))[:bits], np.zeros(longest, dtype=np.uint8)]).astype(np.int64)
                window = np.zeros(bits, dtype=np.int64)
                for k in range(longest):
                    window = (window << 1) | one[k : bits + k]
                which = np.searchsorted(first << (longest - length), window, side="right") - 1
                ends, at, starts = (np.arange(bits) + length[which]).tolist(), 0, []
                for _ in range(n):
                    starts.append(at)
                    at = ends[at]
                kind = which[starts]
                found = place[kind] + (window[starts] >> (longest - length[kind])) - first[kind]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + block * per_block), pa.array(found)], names=["i", "place"])

    places = blocks.select("block", "n", "bits", "data").mapInArrow(run, "i long, place long")
    return lookup(places, codes.select("place", "n", "c"), ["place"], "n").select("i", "c")
