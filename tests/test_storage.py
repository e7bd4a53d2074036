"""Huffman codes, merged suffix orders, samples of common prefixes, and tables on disk."""

import heapq
import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.operators import coords, huffman, suffix
from seqloom.plans import tables
from seqloom.plans.scale import CLEANUP, Scratch

READS = "read_id long, seq string"


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def least_bits(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    if len(heap) == 1:
        return heap[0]
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


@pytest.mark.parametrize("seed", range(40))
def test_lengths_of_runs_are_least(seed):
    draw = random.Random(seed)
    counts = [draw.choice([1, 1, 1, 2, 3, draw.randrange(1, 60), 2 ** draw.randrange(12)]) for _ in range(draw.randrange(1, 90))]
    runs = {n: counts.count(n) for n in set(counts)}
    found = huffman.run_lengths(runs)
    assert {n: sum(m for _, m in x) for n, x in found.items()} == runs
    assert sum(n * length * m for n, x in found.items() for length, m in x) == least_bits(counts)
    assert len(counts) == 1 or sum(m * 2.0**-length for x in found.values() for length, m in x) == 1.0


@pytest.mark.parametrize("symbols", [["x"], ["a", "b"], ["a"] * 50 + list("bcdefgh") * 3 + ["é", "日", ""], [str(i) for i in range(300)] + ["hot"] * 400])
def test_packed_and_back(spark, monkeypatch, symbols):
    monkeypatch.setattr(huffman, "BLOCK", 64)
    draw = random.Random(1)
    plain = [(i, draw.choice(symbols)) for i in range(333)]
    scratch = Scratch(spark)
    seq = spark.createDataFrame(plain, "i long, c string")
    codes = huffman.code_table(seq, scratch)
    listed = codes.collect()
    texts = sorted(f"{x.code:0{x.length}b}" for x in listed)
    assert not any(b.startswith(a) for a, b in zip(texts, texts[1:]))
    bits = least_bits([x.n for x in listed])
    assert tuple(huffman.size(codes).first()) == (333, len(listed), bits)
    packed = scratch.keep(huffman.encode(seq, codes), "packed")
    assert packed.agg(F.sum("bits")).first()[0] == bits and packed.agg(F.max(F.col("offset") + F.col("bits"))).first()[0] == bits
    assert rows(huffman.decode(packed, codes), "i", "c") == sorted(plain, key=str)


def test_no_symbols(spark):
    seq = spark.createDataFrame([], "i long, c string")
    codes = huffman.code_table(seq, Scratch(spark))
    assert tuple(huffman.size(codes).first()) == (0, 0, 0)
    assert huffman.decode(huffman.encode(seq, codes), codes).count() == 0


def test_merged_orders_of_long_reads(spark):
    draw = random.Random(5)
    base = "".join(draw.choices("AC", k=20_000))
    first, second = [base, "ACA", ""], [base[:9_000] + "G" + base[9_001:], "ACA", None]
    made = [spark.createDataFrame(list(enumerate(x)), READS) for x in (first, second)]
    orders = [suffix.suffix_order_doubling(x, Scratch(spark)) for x in made]
    ranks = suffix.insertion_ranks_doubling(*made, Scratch(spark))
    found = suffix.merge_orders(*orders, ranks)
    want = sorted((s[p:], k, i, p) for k, x in enumerate((first, second)) for i, s in enumerate(y or "" for y in x) for p in range(len(s) + 1))
    got = [(bool(x.second), x.read_id, x.pos) for x in found.orderBy("sa_idx").collect()]
    assert got == [(bool(k), i, p) for _, k, i, p in want]
    assert found.agg(F.min("sa_idx"), F.max("sa_idx")).first() == (0, len(want) - 1)


def test_common_prefixes_from_samples(spark):
    draw = random.Random(6)
    reads, scratch = spark.createDataFrame([(i, "".join(draw.choices("AC", k=n))) for i, n in enumerate((60, 0, 3, 90))], READS), Scratch(spark)
    values = scratch.keep(suffix.plcp(suffix.lcp(suffix.suffix_order(reads, scratch)), coords.with_starts(reads, scratch)), "plcp")
    samples = suffix.plcp_samples(values)
    assert samples.count() < values.count() / 2
    assert rows(suffix.plcp_from_samples(samples, values), "text_pos", "plcp") == rows(values, "text_pos", "plcp")


def test_ranges_read_few_files(spark, tmp_path):
    table = spark.range(1000).select(F.col("id").alias("sa_idx"), (F.col("id") * 7).alias("x"))
    tables.save(table, str(tmp_path), files=10)
    assert rows(tables.load(spark, str(tmp_path)), "sa_idx", "x") == rows(table, "sa_idx", "x")
    for first, last, most in ((0, 5, 1), (120, 180, 2), (990, 5000, 1), (5000, 6000, 10), (7, 3, 1), (0, 999, 10)):
        found = tables.rows_between(spark, str(tmp_path), first, last)
        assert rows(found, "sa_idx") == sorted(((x,) for x in range(max(first, 0), min(last, 999) + 1)), key=str)
        assert len(found.inputFiles()) <= most
    spark.read.parquet(f"{tmp_path}/manifest").withColumn("version", F.lit(99)).write.parquet(f"{tmp_path}/other/manifest")
    with pytest.raises(ValueError, match="version 99"):
        tables.load(spark, f"{tmp_path}/other")


def test_shuffle_files_go_when_a_table_is_kept(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    kept = Scratch(spark).keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before
    assert {x["count"] for x in kept.collect()} == {142, 143}
    assert spark.conf.get(CLEANUP, None) != "true"
