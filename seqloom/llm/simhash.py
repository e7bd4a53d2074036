"""SimHash near-duplicates by vantage-point trees.

Fingerprints are 64 bits. Each inner node of a tree has a vantage point and a radius: a fingerprint
is at home inside or outside. Two fingerprints that differ in at most LINK_BITS bits have distances
to the vantage that differ by no more, so only fingerprints in a band of that width along the
boundary can have partners on its other side. The band's outer part is sent inside as queries;
whatever lies farther is pruned. A tree over a bounded sample deals all fingerprints to shards;
each shard goes on with trees of its own and compares what is left pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SLICE, slices
from .common import Scratch, fresh, small_batches, task, worker_state
from .components import Links, connected

LINK_BITS = 3
SHINGLE_WORDS = 3
#: Fingerprints that the driver sees to grow the shards' tree: at most so many, and a quarter of all.
SAMPLE = 100_000
#: Fingerprints at home in a shard, about: its own trees take a second over so many, and each level of the
#: tree over shards sends more of them to several. The least of the sample's in a leaf.
SHARD_ROWS, SAMPLE_LEAF = 131_072, 16
#: Rows of a shard above which it is dealt to several tasks, each with two parts of it.
TASK_ROWS = 400_000
#: Pairs that are compared at once.
PAIRS = 4_000_000
#: Byte j of entry b is bit j of b: adds bits up in eight lanes at a time.
LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included.

    A-Z is lower-cased; a bit is 1 if it is set in over half of the shingles' XXH64 values. A text
    with fewer words has one shingle of them all, one without words (or null) has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxh64_intdigest(b" ".join(found), seed)
    n = len(found) - words + 1
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=seed), map(b" ".join, zip(*(found[k:] for k in range(words))))), dtype=np.uint64, count=n)
    lanes = LANES[hashes.astype("<u8").view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
    ones = sums.sum(axis=0, dtype=np.int64) * 2 > n
    return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with the fingerprints of whole texts (bigint, the 64 bits as they are) in the place of the text."""
    rest = [c for c in docs.columns if c not in (text_col, out)]
    schema = docs.select(*rest).withColumn(out, F.lit(0).cast("long")).schema

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, int)
        for batch in batches:
            column, found = batch.column(text_col), []
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), SLICE):
                found += [fingerprint(x, words) for x in column.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*rest, out])

    return docs.mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def cut(points: np.ndarray, bits: int, tries: int = 8) -> tuple[int, int, float] | None:
    """A vantage point and a radius for points, and the pairs that are left as a share of all.

    Of a few points, evenly picked, the one whose best radius leaves the fewest pairs: those at
    home inside with all that are sent there, and those outside.
    """
    n, best = len(points), None
    for vantage in points[:: max(1, n // tries)][:tries]:
        inside = np.cumsum(np.bincount(distance(points, vantage), minlength=65 + bits))
        radius = np.arange(64)
        within, outside, band = inside[radius], n - inside[radius], inside[radius + bits] - inside[radius]
        left = within * (within + 2 * band) + outside * outside
        k = int(np.argmin(np.where((within > 0) & (outside > 0), left, n * n)))
        if 0 < within[k] < n and (best is None or left[k] < best[2]):
            best = int(vantage), k, float(left[k])
    return None if best is None else (best[0], best[1], best[2] / n**2)


class Node:
    def __init__(self, vantage: int, radius: int, inner, outer):
        self.vantage, self.radius, self.inner, self.outer = np.uint64(vantage), radius, inner, outer


def grow(sample: np.ndarray, leaf: int, bits: int, counter: list[int]):
    """A tree over the sample: Nodes, with the numbers of shards as leaves."""
    best = cut(sample, bits) if len(sample) > max(leaf, 2 * SAMPLE_LEAF) else None
    if best is None or best[2] > 0.9:
        counter[0] += 1
        return counter[0] - 1
    inside = distance(sample, np.uint64(best[0])) <= best[1]
    return Node(best[0], best[1], grow(sample[inside], leaf, bits, counter), grow(sample[~inside], leaf, bits, counter))


def parted(home: np.ndarray, query: np.ndarray, points: np.ndarray, vantage: np.uint64, radius: int, bits: int):
    """((home, query) inside, (home, query) outside) of rows of points.

    A pair is found where one of the two is at home and the other at home or a query: those at
    home outside, but near, go inside as queries; queries go wherever a partner may be at home.
    """
    h, q = distance(points[home], vantage), distance(points[query], vantage)
    inner = home[h <= radius], np.concatenate([query[q <= radius + bits], home[(h > radius) & (h <= radius + bits)]])
    return inner, (home[h > radius], query[q > radius - bits])


def routed(tree, points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows at home, rows sent as queries) for all points."""
    stack = [(tree, np.arange(len(points)), np.arange(0))]
    while stack:
        node, home, query = stack.pop()
        if not len(home) and not len(query):
            continue
        if isinstance(node, int):
            yield node, home, query
            continue
        inner, outer = parted(home, query, points, node.vantage, node.radius, bits)
        stack += [(node.inner, *inner), (node.outer, *outer)]


def link(points: np.ndarray, home: np.ndarray, query: np.ndarray, bits: int) -> Links:
    """Join all rows of points that differ in at most bits bits, one of them at home."""
    links, stack = Links(len(points)), [(home, query)]
    while stack:
        home, query = stack.pop()
        if not len(home):
            continue
        best = cut(points[home], bits) if len(home) > 512 else None
        if best and best[2] < 0.8:
            stack += parted(home, query, points, np.uint64(best[0]), best[1], bits)
            continue
        rest = np.concatenate([home, query])
        others, step = points[rest], max(1, PAIRS // len(rest))
        for a in range(0, len(home), step):
            near = distance(points[home[a : a + step], None], others[None, a:]) <= bits
            near[np.arange(len(near)), np.arange(len(near))] = False
            rows = np.flatnonzero(near.any(axis=1))
            for k in rows.tolist():
                links.join(np.append(rest[a:][near[k]], home[a + k]))
    return links


def fingerprint_links(distinct: DataFrame, scratch: Scratch, *, bits: int = LINK_BITS) -> DataFrame:
    """Links (a, b) between the values of distinct(fingerprint) that connect whatever differs in
    at most bits bits, directly or over others: a forest for each task, not all pairs."""
    n = distinct.count()
    share = min(0.25, SAMPLE / max(1, n))
    sampled = distinct.where(F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = sampled.limit(2 * SAMPLE).toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64)
    counter = [0]
    tree = grow(np.sort(sample), max(SAMPLE_LEAF, int(SHARD_ROWS * share)), bits, counter)

    @task
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for shard, home, query in routed(tree, points, bits):
                rows = np.concatenate([home, query])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), pa.array(points[rows].view(np.int64)), pa.array(np.arange(len(rows)) < len(home))], names=["shard", "fingerprint", "home"])

    dealt = scratch.keep(distinct.select("fingerprint").mapInArrow(deal, "shard long, fingerprint long, home boolean"), "dealt")
    parts = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("parts"))
    # There are at most SAMPLE / SAMPLE_LEAF shards, whatever the data's size.
    cells = dealt.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    whole = cells.where("parts = 1").select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "fingerprint", "home")
    large = cells.where("parts > 1")
    as_home = large.where("home").select("shard", F.col("part").alias("i"), F.explode(each).alias("j"), "fingerprint", "home")
    # In a cell with i = j a row at home is there already.
    as_query = large.select("shard", F.explode(F.filter(each, lambda i: ~F.col("home") | (i != F.col("part")))).alias("i"), F.col("part").alias("j"), "fingerprint", F.lit(False).alias("home"))
    tasks = whole.unionByName(as_home).unionByName(as_query)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points, home = rows["fingerprint"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool)
        roots = link(points, np.flatnonzero(home), np.flatnonzero(~home), bits).roots(np.arange(len(points)))
        moved = roots != np.arange(len(points))
        return pd.DataFrame({"a": points[moved].view(np.int64), "b": points[roots[moved]].view(np.int64)})

    return tasks.groupBy("shard", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bits: int = LINK_BITS) -> DataFrame:
    """A row per document: doc_id, text_hash, fingerprint, component_id, first.

    Documents are linked if their fingerprints differ in at most bits bits; component_id is the
    smallest id reachable. first tells whether the document is its component's first: by id (null
    last), then by a hash of the text. Null and empty texts have fingerprint 0 and link like any
    other. Rows that repeat id and text are all first or none. An empty table gives no rows.
    Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    marked = scratch.keep(fingerprints(slim, words=words), "marked")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    distinct = scratch.keep(marked.groupBy("fingerprint").agg(F.min(place).alias("place")), "distinct")
    found = connected(fingerprint_links(distinct.select("fingerprint"), scratch, bits=bits), scratch)
    named = found.join(distinct, F.col("node") == F.col("fingerprint")).select("root", "fingerprint", "place")
    named = scratch.keep(named, "named")
    tops = scratch.keep(named.groupBy("root").agg(F.min("place").alias("top")), "tops")
    moved = scratch.keep(named.join(tops, "root").select("fingerprint", "top"), "moved")
    placed = distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("top", "place").alias("top"))
    placed = scratch.keep(placed, "placed")
    scratch.drop("dealt")
    out = marked.join(placed, "fingerprint")
    first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    return out.select("doc_id", "text_hash", "fingerprint", F.col("top.doc_id").alias("component_id"), first.alias("first"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component: its first; of rows that repeat id and text, any one."""
    scratch = Scratch(docs.sparkSession, "dedup")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    doc, digest, once_col = fresh(docs, "doc", "digest", "once")
    found = scratch.keep(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), "first"), "found")
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))

    def same(keys: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(keys[doc]) & (text_hash == keys[digest])

    others = found.where("NOT first").select(doc, digest).distinct()
    kept = docs.join(others, same(others), "left_anti")
    repeated = scratch.keep(found.where("first").groupBy(doc, digest).count().where("count > 1").select(doc, digest), "repeated")
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same(repeated), "left_semi").withColumn(once_col, text_hash).dropDuplicates([id_col, once_col]).drop(once_col)
    return kept.join(repeated, same(repeated), "left_anti").unionByName(once)
