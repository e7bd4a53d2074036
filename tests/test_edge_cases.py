"""Cases beside the tables: null reads, files with odd lines, long patterns and the paths beyond a broadcast."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import codes, coords, kmers, patterns, profiles, suffix
from seqloom.plans.scale import Scratch
from seqloom.sources import numbers
from seqloom.sources import reads as sources
from seqloom.streaming import counts

READS = "read_id long, seq string"


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def some_reads(spark, n=12, seed=3):
    draw = random.Random(seed)
    found = [(i, "".join(draw.choice("ACGT") for _ in range(draw.choice([0, 3, 40, 700])))) for i in range(n)]
    return spark.createDataFrame([*found, (n, None)], READS), [*found, (n, None)]


def test_null_reads_have_a_terminator(spark):
    reads = spark.createDataFrame([(0, "AC"), (1, None), (2, "G")], READS)
    starts = coords.with_starts(reads, Scratch(spark))
    asked = spark.createDataFrame([(i, i) for i in range(7)], "query_id long, text_pos long")
    assert rows(coords.text_to_read(starts, asked), "text_pos", "read_id", "pos") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 2, 0), (5, 2, 1)]
    back = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "query_id long, read_id long, pos long")
    assert rows(coords.read_to_text(starts, back), "query_id", "text_pos") == [(0, 3)]
    assert rows(coords.valid_positions(starts, 2), "read_id", "n") == [(0, 1), (1, 0), (2, 0)]
    assert [tuple(x) for x in coords.read_ranges(starts).orderBy("read_id").collect()][1] == (1, None, None)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_headers_may_have_the_sign(spark, tmp_path, end):
    (tmp_path / "x.fa").write_bytes(end.join([">one a>b >c", "ACGT", "AC", ">two", "G>T", ">three", ""]).encode())
    assert rows(sources.read_fasta(spark, str(tmp_path / "x.fa")), "name", "seq") == [("one a>b >c", "ACGTAC"), ("three", ""), ("two", "G>T")]


def test_many_integers(spark, tmp_path):
    values = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    (tmp_path / "n").mkdir()
    values[:600].tofile(tmp_path / "n" / "a")
    values[600:].tofile(tmp_path / "n" / "b")
    assert rows(numbers.read_integers(spark, str(tmp_path / "n")), "i", "c") == list(enumerate(values.tolist()))


@pytest.mark.parametrize("few", [True, False])
def test_counts_of_asked_kmers(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(kmers, "BROADCAST_KMERS", 1)
    reads, _ = some_reads(spark)
    every = kmers.extract(reads, 4)
    asked = spark.createDataFrame([(0, "ACGT"), (1, "AAAA"), (2, "QQQQ"), (3, None)], "query_id long, kmer string")
    want = rows(kmers.count_for(kmers.stats(every), asked.where("kmer IS NOT NULL")), "query_id", "q2", "q4")
    assert rows(kmers.count_for(kmers.stats(kmers.only(every, asked)), asked.where("kmer IS NOT NULL")), "query_id", "q2", "q4") == want and want[2] == (2, 0, 0)
    names = ("read_id", "n_kmers", "n_found", "min_q2", "max_q2", "sum_q2")
    assert rows(profiles.own_summary(every), *names) == rows(profiles.summary(profiles.profile(reads, kmers.stats(every), 4)), *names)


def test_symbols_before_kmers(spark):
    reads, plain = some_reads(spark)
    want = {}
    for _, seq in plain:
        for p in range(len(seq or "") - 2):
            key = seq[p : p + 3], seq[p - 1] if p else None
            want[key] = want.get(key, 0) + 1
    assert {(x.kmer, x.symbol): x.n for x in kmers.left_neighbours(reads, 3).collect()} == want


@pytest.mark.parametrize("few", [True, False])
def test_long_patterns_by_seeds(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(patterns, "BROADCAST_SYMBOLS", 0)
    reads, plain = some_reads(spark)
    draw = random.Random(1)
    asked = [(0, "AC"), (1, "ACGTACGTAC"), (2, "")]
    for k, (_, seq) in enumerate(plain):
        if seq and len(seq) > 300:
            asked += [(10 * k + j, seq[a : a + n]) for j, n in enumerate((8, 15, 16, 90, 300)) for a in [draw.randrange(len(seq) - n)]]
    found = patterns.locate(reads, spark.createDataFrame(asked, "pattern_id long, pattern string"), scan_up_to=0)
    want = sorted((i, r, p) for i, x in asked if x for r, seq in plain for p in range(len(seq or "")) if seq.startswith(x, p))
    assert rows(found, "pattern_id", "read_id", "pos") == want


def test_stream_counts_long_reads(spark, tmp_path):
    reads, _ = some_reads(spark, seed=5)
    reads.write.parquet(str(tmp_path / "in"))
    found = counts.kmer_counts(spark.readStream.schema(READS).parquet(str(tmp_path / "in")), 5)
    counts.into_table(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(counts.latest(spark.read.parquet(str(tmp_path / "out"))), "kmer", "q2", "q4") == rows(kmers.stats(kmers.extract(reads, 5)), "kmer", "q2", "q4")


def test_dense_alphabet(spark):
    seq = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "i long, c string")
    assert rows(codes.dense_alphabet(seq, Scratch(spark)), "c", "mapped") == [("a", 1), ("b", 2)]
    assert codes.dense_alphabet(seq.where(F.lit(False)), Scratch(spark)).count() == 0


def test_reads_with_the_printed_terminator(spark):
    seqs = ["a$b$", "$a", "", "$$", None]
    reads = spark.createDataFrame(list(enumerate(seqs)), READS)
    order = suffix.suffix_order(reads, Scratch(spark))
    sa = [(i, p) for _, i, p in sorted((s[p:].encode(), i, p) for i, s in enumerate(x or "" for x in seqs) for p in range(len(s) + 1))]
    before = [seqs[i][p - 1] if p else None for i, p in sa]
    symbols = suffix.bwt(order, reads)
    assert [x.symbol for x in symbols.orderBy("sa_idx").collect()] == before
    assert suffix.bwt_runs(symbols).first()[0] == sum(c is not None and (k == 0 or before[k - 1] != c) for k, c in enumerate(before))
    smaller = lambda c: sum(x is None or (c is not None and x < c) for x in before) if c is not None else 0
    assert {(x.symbol, x.n, x.first) for x in suffix.symbol_starts(symbols).collect()} == {(c, before.count(c), smaller(c)) for c in set(before)}
    assert rows(suffix.last_to_first(symbols), "sa_idx", "lf") == [(k, sa.index((i, p - 1))) for k, (i, p) in enumerate(sa) if p]
    found = {(x.kmer, x.symbol): x.n for x in kmers.left_neighbours(reads, 1).collect()}
    assert found[("a", None)] == 1 and found[("$", None)] == 2 and found[("a", "$")] == 1 and found[("$", "$")] == 1


@pytest.mark.parametrize("seq,pattern", [("AC" * 1_000_000, "A"), ("A" * 300_000, "AAAA")])
def test_a_million_matches_in_a_read(spark, seq, pattern):
    reads = spark.createDataFrame([(1, seq)], READS)
    asked = spark.createDataFrame([(0, pattern)], "pattern_id long, pattern string")
    found = patterns.locate(reads, asked).agg(F.count(F.lit(1)), F.sum("pos"), F.max("pos")).first()
    at = [p for p in range(len(seq)) if seq.startswith(pattern, p)]
    assert tuple(found) == (len(at), sum(at), at[-1])


def test_a_very_long_pattern_beside_short_ones(spark):
    draw = random.Random(8)
    long = "".join(draw.choices("ACGT", k=300_000))
    plain = [(0, long + "AC"), (1, "G" + long), (2, long[:-1] + ("A" if long[-1] != "A" else "C")), (3, long[:3000])]
    asked = [(0, long), (1, long[:2000]), (2, long[5:400]), (3, long[:20]), (4, long[7:9])]
    found = patterns.locate(spark.createDataFrame(plain, READS), spark.createDataFrame(asked, "pattern_id long, pattern string").where("pattern_id < 4"), scan_up_to=0)
    want = sorted((i, r, p) for i, x in asked[:4] for r, s in plain for p in (s.find(x),) if p >= 0)
    assert rows(found, "pattern_id", "read_id", "pos") == want


@pytest.mark.parametrize("context", [0, 3, 3000])
def test_context_across_pieces(spark, context):
    draw = random.Random(2)
    plain = [(i, "".join(draw.choices("AC", k=n))) for i, n in enumerate((0, 4, 1023, 1030, 5000))]
    found = patterns.grep_context(spark.createDataFrame(plain, READS), "ACCA", context)
    want = sorted((r, p, s[max(p - context, 0) : p + 4 + context]) for r, s in plain for p in range(len(s)) if s.startswith("ACCA", p))
    assert rows(found, "read_id", "pos", "match") == want


def test_counts_of_whole_reads(spark, monkeypatch):
    """Counts without a row for each occurrence, in groups of reads, by numbers, by texts and for long reads."""
    draw = random.Random(5)
    texts = ["", None, "A", "ACG", "AAAAAAA", "日é\0日é\0日", "x" * 300] + ["".join(draw.choices("ACGTN", k=draw.randrange(90))) for _ in range(60)]
    texts += ["".join(map(chr, draw.sample(range(0x4E00, 0x9000), 40))) for _ in range(3)]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string").coalesce(2).cache()
    for k, counted, whole in ((1, 200, 100), (3, 1 << 21, 1 << 17), (8, 50, 20), (40, 1 << 21, 1 << 17)):
        monkeypatch.setattr(kmers, "COUNTED", counted)
        monkeypatch.setattr(kmers, "WHOLE", whole)
        want = rows(kmers.stats(kmers.extract(reads, k)), "kmer", "q2", "q4")
        found = kmers.read_stats(reads, k)
        assert rows(found, "kmer", "q2", "q4") == want and want
        monkeypatch.setattr(profiles, "BROADCAST_COUNTS", k * 10)
        names = ["read_id", "n_kmers", "n_found", "min_q2", "max_q2", "sum_q2"]
        assert rows(profiles.whole_summary(reads, found, k), *names) == rows(profiles.own_summary(kmers.extract(reads, k)), *names)
    assert "read_id" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # no shuffle by read and k-mer


def test_queries_meet_reads_without_a_shuffle_of_kmers(spark, monkeypatch):
    """q1_report_reads and q3_report_occurrences shuffled a row for each k-mer of the reads."""
    draw = random.Random(6)
    texts = ["", None, "ACG", "AAAAAAA", "日é日é日é日"] + ["".join(draw.choices("ACGTN", k=draw.randrange(400))) for _ in range(40)]
    reads = spark.createDataFrame([*enumerate(texts), (9, texts[9]), (9, "AAAAACCC")], READS)  # a read_id that repeats
    asked = spark.createDataFrame([(1, "AAA"), (1, "AAA"), (2, "AAA"), (None, "AAA"), (3, "é日é"), (4, "TTTTT"), (5, None), (6, "ACG")], "query_id long, kmer string")
    found = kmers.extract(kmers.by_read(reads), 3)
    three, one = ["query_id", "read_id", "pos"], ["query_id", "read_id", "last_pos"]
    got = rows(kmers.report_occurrences(found, asked).na.fill(-1), *three), rows(kmers.report_reads(found, asked).na.fill(-1), *one)
    places = [(-1 if q is None else q, r, p) for q, x in asked.collect() for r, s in reads.collect() for p in range(len(s or "") - 2) if s[p : p + 3] == x]
    assert got[0] == sorted(places) and {q for q, _, _ in places} == {-1, 1, 2, 3, 6}
    last = {(q, r): max(p for a, b, p in places if (a, b) == (q, r)) for q, r, _ in places}
    assert got[1] == sorted((*k, p) for k, p in [*last.items(), *(x for x in last.items() if x[0][0] == 1)])  # query 1 is asked twice
    for plan in (kmers.report_occurrences(found, asked), kmers.report_reads(found, asked)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and not [x for x in text.splitlines() if "Exchange hashpartitioning(kmer" in x and "read_id" in x]
    monkeypatch.setattr(kmers, "BROADCAST_QUERIES", 3)
    assert got == (rows(kmers.report_occurrences(found, asked).na.fill(-1), *three), rows(kmers.report_reads(found, asked).na.fill(-1), *one))


def test_seeds_meet_reads_without_a_shuffle(spark, monkeypatch):
    """pattern_locate_seeded shuffled the pieces of all reads and, for many patterns, each k-mer."""
    draw = random.Random(7)
    plain = [(i, "".join(draw.choices("AC", k=n))) for i, n in enumerate((0, 15, 255, 256, 257, 511, 512, 3000, 9000))] + [(9, "é" * 600), (10, None)]
    asked = [(i, plain[r][1][a : a + n]) for i, (r, a, n) in enumerate([(2, 240, 15), (3, 240, 16), (4, 241, 16), (5, 250, 9), (6, 256, 256), (7, 250, 257), (7, 900, 2048), (8, 100, 2049), (8, 20, 8000), (8, 8984, 16), (9, 3, 20), (7, 1023, 8)])]
    reads, listed = spark.createDataFrame(plain, READS), spark.createDataFrame(asked, "pattern_id long, pattern string")
    want = sorted((i, r, p) for i, x in asked for r, s in plain if s for p in range(len(s)) if s.startswith(x, p))
    found = patterns.locate(reads, listed, scan_up_to=0)
    assert rows(found, "pattern_id", "read_id", "pos") == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    for n in (16, 256):  # of one length
        mine = patterns.locate(reads, listed.where(F.length("pattern") == n), scan_up_to=0)
        assert rows(mine, "pattern_id", "read_id", "pos") == [x for x in want if len(asked[x[0]][1]) == n]
        assert "MapInArrow" in mine._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(patterns, "BROADCAST_BYTES", 0)
    assert rows(patterns.locate(reads, listed, scan_up_to=0), "pattern_id", "read_id", "pos") == want


@pytest.mark.parametrize("k", [1, 3, 11, 16])
def test_asked_kmers_are_found_in_the_reads_row(spark, monkeypatch, k):
    """q3_report_occurrences made a row for each k-mer of the reads before it looked it up."""
    draw = random.Random(k)
    texts = ["", None, "A", "日é\0日é\0日é日é日é日é日é日é日é日", "N" * 300] + ["".join(draw.choices("ACGT", k=draw.randrange(200))) for _ in range(40)]
    reads = spark.createDataFrame([*enumerate(texts), (None, "ACGT" * 9), (4, "N" * 20)], READS).coalesce(2)
    some = [(i, s[len(s) // 3 :][:k]) for i, s in enumerate(texts) if s and i % 3 < 2]
    asked = spark.createDataFrame([*some, (98, None), (99, "ACGT" * 9), (100, "")], "query_id long, kmer string")
    want = rows(kmers.report_occurrences(kmers.extract(reads, k), asked).na.fill(-1), "query_id", "read_id", "pos")
    every = set(map(tuple, kmers.extract(reads, k).collect()))
    for counted, whole, most in ((1 << 21, 1 << 17, 1 << 22), (150, 100, 1 << 22), (50, 10, 3)):
        for name, value in (("COUNTED", counted), ("WHOLE", whole), ("BROADCAST_QUERIES", most)):
            monkeypatch.setattr(kmers, name, value)
        found = kmers.extract_asked(reads, k, asked)
        assert rows(kmers.report_occurrences(found, asked).na.fill(-1), "query_id", "read_id", "pos") == want and want
        got = [tuple(x) for x in found.collect()]
        assert set(got) <= every
        if k == 16 and whole > 1000:
            assert len(got) < len(every) * 3 / 4
