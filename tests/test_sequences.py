"""Hand-checked values and edge cases of the sequence operators."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as fn
from seqloom.operators import coords, kmers, patterns, profiles, rankselect, suffix
from seqloom.plans import index as store
from seqloom.plans import scale
from seqloom.plans.scale import Scratch
from seqloom.sources import numbers
from seqloom.sources import reads as src

SAMPLE = ["GATTACAGATTACA", "TGTAATCTGTAATC", ""]


def reads_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def brute(seqs, k):
    return [(i, p, s[p : p + k]) for i, s in enumerate(seqs) for p in range(len(s or "") - k + 1)]


def test_sample_counts(spark):
    found = kmers.stats(kmers.extract(reads_of(spark, SAMPLE), 3))
    got = {x.kmer: (x.q2, x.q4) for x in found.collect()}
    twice = "AAT ACA ATC ATT GAT GTA TAA TAC TGT TTA".split()
    assert got == {**dict.fromkeys(twice, (1, 2)), **dict.fromkeys("AGA CAG CTG TCT".split(), (1, 1))}


@pytest.mark.parametrize("k", [1, 3, 8, 14, 15])
def test_extract_covers_each_position_once(spark, k):
    seqs = [*SAMPLE, "A" * 255, "AC" * 128, "ACGT" * 65, "A" * 1025, "éßN日本", None, "GAT"]
    assert rows(kmers.extract(reads_of(spark, seqs), k), "read_id", "pos", "kmer") == sorted(brute(seqs, k))


def test_queries_on_the_sample(spark):
    found = kmers.extract(reads_of(spark, SAMPLE), 3)
    asked = spark.createDataFrame([(0, "ACA"), (1, "CAG"), (2, "CCC")], "query_id long, kmer string")
    assert rows(kmers.report_occurrences(found, asked), "query_id", "read_id", "pos") == [(0, 0, 4), (0, 0, 11), (1, 0, 5)]
    assert rows(kmers.report_reads(found, asked), "query_id", "read_id", "last_pos") == [(0, 0, 11), (1, 0, 5)]
    assert rows(kmers.count_for(kmers.stats(found), asked), "query_id", "q2", "q4") == [(0, 1, 2), (1, 1, 1), (2, 0, 0)]


def test_empty_collection(spark):
    none = reads_of(spark, [])
    assert kmers.stats(kmers.extract(none, 3)).count() == 0
    assert rows(coords.collection_size(none), "total_length", "n_reads", "max_length") == [(0, 0, 0)]
    assert coords.with_starts(none, Scratch(spark)).count() == 0


def test_coordinates(spark):
    starts = coords.with_starts(reads_of(spark, SAMPLE), Scratch(spark))
    assert rows(starts, "read_id", "start_pos") == [(0, 0), (1, 15), (2, 30)]
    asked = spark.createDataFrame([(i, x) for i, x in enumerate([0, 14, 15, 30, 31, -1])], "query_id long, text_pos long")
    assert rows(coords.text_to_read(starts, asked), "text_pos", "read_id", "pos") == [(0, 0, 0), (14, 0, 14), (15, 1, 0), (30, 2, 0)]
    assert rows(coords.valid_positions(starts, 3), "read_id", "last_pos", "n") == [(0, 11, 12), (1, 26, 12), (2, None, 0)]
    assert rows(coords.collection_size(starts), "total_length", "n_reads", "max_length") == [(31, 3, 14)]


def test_reverse_complement(spark):
    df = spark.createDataFrame([("GATTACAGATTACA",), ("ACGTN",), ("acgt",), ("",)], "s string").select(fn.reverse_complement(F.col("s")).alias("r"))
    assert [x.r for x in df.collect()] == ["TGTAATCTGTAATC", "NACGT", "NNNN", ""]


def test_profile_has_absent_kmers(spark):
    counts = kmers.stats(kmers.extract(reads_of(spark, SAMPLE), 3))
    got = profiles.profile(reads_of(spark, ["GATCC", "GA"]), counts, 3)
    assert rows(got, "read_id", "pos", "kmer", "q2") == [(0, 0, "GAT", 1), (0, 1, "ATC", 1), (0, 2, "TCC", 0)]
    turned = profiles.reverse_profile(reads_of(spark, SAMPLE[:1]), counts, 3)
    assert {x.q2 for x in turned.collect()} == {1}


def test_patterns(spark):
    reads = reads_of(spark, [*SAMPLE[:2], "AAAA", "a.b.c", "x\\Ey\\Ex"])
    asked = ["TTA", "GATTACA", "TGTAATC", "ATAT", "AA", ".", "\\E", "A"]
    listed = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    seqs = [x.seq for x in reads.orderBy("read_id").collect()]
    want = sorted((i, r, p) for i, x in enumerate(asked) for r, s in enumerate(seqs) for p in range(len(s)) if s.startswith(x, p))
    assert rows(patterns.locate(reads, listed), "pattern_id", "read_id", "pos") == want
    many = spark.createDataFrame([(0, "GATTACAGA"), (1, "AA"), (2, "TGTAATCTG")], "pattern_id long, pattern string")
    assert rows(patterns.locate(reads, many, scan_up_to=0), "pattern_id", "read_id", "pos") == rows(patterns.locate(reads, many), "pattern_id", "read_id", "pos")
    assert rows(patterns.grep_context(reads, "GATTACA", 2), "read_id", "pos", "match") == [(0, 0, "GATTACAGA"), (0, 7, "CAGATTACA")]
    counted = {x.pattern_id: (x.n_occurrences, x.n_reads) for x in patterns.count(reads, listed).collect()}
    assert counted[0] == (2, 1) and counted[3] == (0, 0)
    assert counted[4] == (sum(s.startswith("AA", p) for s in seqs for p in range(len(s))), sum("AA" in s for s in seqs))


def test_suffix_order_of_the_sample(spark):
    scratch = Scratch(spark)
    order = suffix.suffix_order(reads_of(spark, SAMPLE), scratch)
    symbols = suffix.bwt(order, reads_of(spark, SAMPLE))
    assert "".join(x.symbol or "$" for x in symbols.orderBy("sa_idx").collect()) == "AC$CTTTTCAAGGTAATA$TTGGTTAAC$AA"
    assert suffix.bwt_runs(symbols).first()[0] == 17
    two = suffix.suffix_order(reads_of(spark, SAMPLE[:2]), scratch, "two")
    common = [x.lcp for x in suffix.lcp(two).orderBy("sa_idx").collect()]
    assert common[2:] == [0, 1, 4, 1, 3, 1, 1, 3, 2, 6, 0, 1, 2, 1, 0, 7, 1, 6, 0, 5, 2, 4, 1, 2, 1, 7, 1, 5]


def test_prefix_doubling_equals_the_sort(spark):
    draw = random.Random(3)
    seqs = ["A" * 70, "A" * 70, "", "ACAC" * 20, *["".join(draw.choice("AC") for _ in range(draw.randrange(60))) for _ in range(12)]]
    direct = suffix.suffix_order(reads_of(spark, seqs), Scratch(spark))
    assert rows(suffix.suffix_order_doubling(reads_of(spark, seqs), Scratch(spark)), "sa_idx", "read_id", "pos") == rows(direct, "sa_idx", "read_id", "pos")
    found = suffix.lcp_doubling(reads_of(spark, seqs), Scratch(spark))
    assert rows(found, "sa_idx", "read_id", "pos", "lcp") == rows(suffix.lcp(direct), "sa_idx", "read_id", "pos", "lcp")
    assert suffix.lcp_doubling(reads_of(spark, seqs).limit(0), Scratch(spark)).count() == 0


def test_rank_and_select(spark, monkeypatch):
    monkeypatch.setattr(scale, "BLOCK", 3)  # several blocks
    seq = spark.createDataFrame(list(enumerate([3, 1, 3, 2, 1, 3])), "i long, c long")
    assert (3, 2, 2) in rows(rankselect.symbol_ranks(seq), "c", "i", "rank")
    assert (5, 3, 3) in rows(rankselect.symbol_ranks(seq), "i", "c", "rank")
    assert {x.i: x.next_i for x in rankselect.select_next(seq).collect()} == {0: 2, 1: 4, 2: 5, 3: None, 4: None, 5: None}
    assert rows(rankselect.distinct_in_range(seq, 1, 4, 1, 2), "c") == [(1,), (2,)]
    assert rows(rankselect.counts_in_range(seq, 1, 4, 1, 2), "n_distinct", "n_rows") == [(2, 3)]
    assert rows(rankselect.rank_less_than(seq, [(2, 2)]), "symbol", "rank") == [(1, 1)]
    bits = spark.createDataFrame(list(enumerate([False, True, True, False, True])), "i long, b boolean")
    ranks = {x.i: (x.rank1, x.rank0) for x in rankselect.bit_ranks(bits).collect()}
    assert ranks[2][0] == 2 and ranks[3][1] == 2
    assert (True, 3, 4) in rows(rankselect.bit_select(bits), "b", "j", "i")
    near = {x.i: (x.prev1, x.next1, x.select_next1) for x in rankselect.bit_neighbours(bits).collect()}
    assert near[1] == (1, 1, 2) and near[3] == (2, 4, 4) and near[0] == (None, 1, 1) and near[4] == (4, 4, None)
    assert rows(rankselect.bit_runs(bits), "start", "length") == [(1, 2), (4, 1)]


def test_merge_is_building_both(spark):
    a, b = ["GATTACA", "", "AC"], ["TTAC", "GATT"]
    scratch = Scratch(spark)
    merged = store.merge(store.build(reads_of(spark, a), 3, scratch), store.build(reads_of(spark, b), 3, Scratch(spark)))
    whole = store.build(reads_of(spark, a + b), 3, Scratch(spark))
    for name, columns in (("reads", ("read_id", "seq", "start_pos")), ("kmers", ("kmer", "read_id", "pos")), ("stats", ("kmer", "q2", "q4"))):
        assert rows(getattr(merged, name), *columns) == rows(getattr(whole, name), *columns)


def test_line_and_number_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("GAT\n\nTACA\n")
    (tmp_path / "b.txt").write_text("AC\n")
    assert rows(src.read_lines(spark, str(tmp_path)), "read_id", "seq") == [(0, "GAT"), (1, ""), (2, "TACA"), (3, "AC")]
    assert rows(src.read_lines(spark, str(tmp_path), skip_empty=True), "read_id", "seq") == [(0, "GAT"), (1, "TACA"), (2, "AC")]
    import struct

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.bin").write_bytes(struct.pack("<3I", 7, 0, 4294967295))
    assert rows(numbers.read_integers(spark, str(tmp_path / "n")), "i", "c") == [(0, 7), (1, 0), (2, 4294967295)]


def test_command_line(spark, tmp_path, capsys):
    from seqloom.__main__ import main, query_totals

    (tmp_path / "reads.txt").write_text("GATTACAGATTACA\nTGTAATCTGTAATC\n\n")
    source, made = str(tmp_path / "reads.txt"), str(tmp_path / "index")
    main(["build", "-k", "3", "-s", "8", source, made])
    index = store.load(spark, made)
    assert index.describe().first().asDict() == {"version": 17, "k": 3, "total_length": 31, "n_reads": 3, "max_length": 14}
    totals = query_totals(index, 1000).first()
    assert totals.asDict() == {"n_queries": 24, "q1": 24, "q2": 24, "q3": 44, "q4": 44}
    main(["grep", "-n", "2", "GATTACA", source])
    main(["profile", "-r", made, "0"])
    main(["locate", "-o", str(tmp_path / "found"), str(tmp_path / "reads.txt"), source])
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "found")).count() == 2
    asked = tmp_path / "patterns"
    asked.write_text("GATTACA\nTT\n")
    main(["locate", str(asked), source])
    main(["locate", "-c", str(asked), source])
    main(["display", source, "0", "1", "3"])
    main(["merge", made, made, str(tmp_path / "both")])
    assert store.load(spark, str(tmp_path / "both")).stats.where("kmer = 'AGA'").first()["q4"] == 2
    main(["bwt", source, str(tmp_path / "bwt")])
    assert "0\t0\tGATTACAGA\n" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "bwt")).count() == 31
    src.write_read(index.reads, 1, str(tmp_path / "one"))
    assert [x.value for x in spark.read.text(str(tmp_path / "one")).collect()] == ["TGTAATCTGTAATC"]
