"""Rank trees, suffix ranges and range queries against plain loops."""

import random

import pytest

from seqloom.operators import backward, patterns, ranktree, suffix
from seqloom.operators import ranges as ranges_
from seqloom.operators.ranges import SymbolTree
from seqloom.operators.ranktree import RankTree, sparse_lookup
from seqloom.plans.scale import Scratch


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_ranks_of_sparse_rows(spark):
    draw = random.Random(1)
    plain = [(draw.choice("ab"), draw.choice([draw.randrange(50), draw.randrange(10**12), 10**12])) for _ in range(300)]
    asked = [(k, draw.choice("abc"), draw.choice([p for _, p in plain] + [0, 1, 10**12 + 1, 1 << 45, -5]) + draw.randrange(2)) for k in range(200)]
    tree = RankTree(spark.createDataFrame(plain, "key string, at long"), ["key"], Scratch(spark), "t")
    found = tree.before(spark.createDataFrame(asked, "q long, key string, at long"), ["q"])
    assert rows(found, "q", "rank") == sorted(((q, sum(k == key and p < at for k, p in plain)) for q, key, at in asked), key=str)


@pytest.mark.parametrize("ones", [[], [0], [5, 10**12], sorted(random.Random(3).sample(range(10**12), 2000))])
def test_sparse_vectors(spark, ones):
    draw = random.Random(2)
    asked = [(k, v) for k, v in enumerate([0, 1, 5, 6, 10**12, 10**12 + 1] + [max(0, x + draw.randrange(-2, 3)) for x in draw.choices(ones or [7], k=150)])]
    found = sparse_lookup(spark.createDataFrame([(x,) for x in ones], "i long"), spark.createDataFrame(asked, "query_id long, v long"), Scratch(spark))
    want = [(q, v, sum(x <= v for x in ones), sum(x < v for x in ones), next((x for x in ones if x >= v), None)) for q, v in asked]
    assert rows(found, "query_id", "v", "rank", "idx", "i") == sorted(want, key=str)


def test_suffix_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranktree, "BITS", 3)  # several levels
    monkeypatch.setattr(backward, "BLOCK", 4)
    seqs = ["GATTACAGATTACA", "TGTAATC$TGTAATC", "", "$$", None, "éA日A"]
    reads, scratch = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), Scratch(spark)
    order = suffix.suffix_order(reads, scratch)
    asked = list(enumerate(["", "A", "GATTACA", "TTT", "$", "C$T", "日A", "Z", None, "A", "GATTACAGATTACAG", "ATTACAGATTACA"]))
    listed = spark.createDataFrame(asked, "pattern_id long, pattern string")
    found = backward.pattern_ranges(suffix.bwt(order, reads), listed, scratch)
    texts = sorted((s[p:].encode(), i, p) for i, s in enumerate(x or "" for x in seqs) for p in range(len(s) + 1))
    want = []
    for k, x in asked:
        hit = [n for n, (t, _, _) in enumerate(texts) if x is not None and t and t.startswith(x.encode())]
        want.append((k, min(hit, default=1), max(hit, default=0)))
    assert rows(found, "pattern_id", "sp", "ep") == sorted(want, key=str)
    counted = {x.pattern_id: x.n_occurrences for x in patterns.count(reads, listed.where("pattern IS NOT NULL")).collect()}
    assert counted == {k: b - a + 1 for k, a, b in want if asked[k][1] is not None}
    ranges = found.withColumnRenamed("pattern_id", "query_id")
    places = [(k, texts[n][1], texts[n][2]) for k, a, b in want for n in range(a, b + 1)]
    assert rows(backward.report_occurrences(ranges, order), "query_id", "read_id", "pos") == sorted(places, key=str)
    last = {(k, r): max(p for k2, r2, p in places if (k2, r2) == (k, r)) for k, r, _ in places}
    assert rows(backward.report_reads(ranges, order), "query_id", "read_id", "last_pos") == sorted(((*k, p) for k, p in last.items()), key=str)
    assert rows(backward.count_for(ranges, order), "query_id", "q2", "q4") == sorted(((k, len({r for k2, r, _ in places if k2 == k}), b - a + 1) for k, a, b in want), key=str)
    assert "NestedLoop" not in backward.report_occurrences(ranges, order)._jdf.queryExecution().toString()


@pytest.mark.parametrize("least,most", [(0, 1), (0, 40), (-300, 70_000)])
def test_range_queries(spark, monkeypatch, least, most):
    monkeypatch.setattr(ranktree, "BITS", 4)
    draw = random.Random(most)
    plain = [(i, draw.randrange(least, most + 1)) for i in range(150)]
    asked = [(k, draw.randrange(-3, 160), draw.randrange(-3, 160), draw.randrange(least - 2, most + 3), draw.randrange(least - 2, most + 3)) for k in range(40)] + [(40, 0, 149, -(10**9), 10**9), (41, 0, 10**9, 10**8, 10**9)]
    tree = SymbolTree(spark.createDataFrame(plain, "i long, c long"), Scratch(spark))
    queries = spark.createDataFrame(asked, "query_id long, first long, last long, least long, most long")
    hit = [(q, i, c) for q, a, b, x, y in asked for i, c in plain if a <= i <= b and x <= c <= y]
    assert rows(tree.counts(queries), "query_id", "n") == sorted(((q[0], sum(h[0] == q[0] for h in hit)) for q in asked), key=str)
    assert rows(tree.distinct(queries), "query_id", "c", "n") == sorted({(q, c, sum(h[0] == q and h[2] == c for h in hit)) for q, _, c in hit}, key=str)
    assert rows(tree.rows(queries), "query_id", "i", "c") == sorted(hit, key=str)
    less = [(q, x, b) for q, a, b, x, y in asked]
    want = []
    for q, c, i in less:
        up = [x for p, x in plain if p <= i and x <= c]
        want.append((q, max(up, default=None), up.count(max(up)) if up else -1))
    assert rows(tree.rank_less_than(spark.createDataFrame(less, "query_id long, c long, i long")), "query_id", "symbol", "rank") == sorted(want, key=str)


@pytest.mark.parametrize("rows_of_a_block", [1, 3, 65_536])
def test_ranks_up_to_a_symbol_need_no_tree_of_symbols(spark, monkeypatch, rows_of_a_block):
    """batch_rank_less_than went down the tree of symbols with each question."""
    monkeypatch.setattr(ranges_, "SEARCHED", rows_of_a_block)
    monkeypatch.setattr(SymbolTree, "tree", None)
    draw = random.Random(7)
    plain = [(i, draw.randrange(-20, 40)) for i in range(60)] + [(60, -(2**40)), (61, 2**40), (62, None)]
    less = [(k, draw.randrange(-30, 50), draw.randrange(-3, 70)) for k in range(60)] + [(60, 2**41, 62), (61, -(2**39), 62), (62, -(2**41), 62), (63, None, 5), (64, 3, None), (65, 2**41, 62)]
    want = []
    for q, c, i in less:
        up = [x for p, x in plain if None not in (x, c, i) and p <= i and x <= c]
        want.append((q, max(up, default=None), up.count(max(up)) if up else -1))
    tree = SymbolTree(spark.createDataFrame(plain, "i long, c long"), Scratch(spark))
    assert rows(tree.rank_less_than(spark.createDataFrame(less, "query_id long, c long, i long")), "query_id", "symbol", "rank") == sorted(want, key=str)
    none = spark.createDataFrame([], "query_id long, c long, i long")
    assert tree.rank_less_than(none).count() == 0
    empty = SymbolTree(spark.createDataFrame([], "i long, c long"), Scratch(spark))
    assert rows(empty.rank_less_than(spark.createDataFrame([(1, 5, 5)], "query_id long, c long, i long")), "symbol", "rank") == [(None, -1)]


def test_no_rows(spark):
    tree = SymbolTree(spark.createDataFrame([], "i long, c long"), Scratch(spark))
    asked = spark.createDataFrame([(1, 0, 5, 0, 5)], "query_id long, first long, last long, least long, most long")
    assert tree.distinct(asked).count() == 0 and rows(tree.counts(asked), "n") == [(0,)]
    none = spark.createDataFrame([], "sa_idx long, symbol string")
    assert rows(backward.pattern_ranges(none, spark.createDataFrame([(0, ""), (1, "A")], "pattern_id long, pattern string"), Scratch(spark)), "sp", "ep") == [(1, 0), (1, 0)]


def test_symbols_are_not_broadcast(spark):
    """A row for each symbol is estimated at the size of the reads' file."""
    reads = spark.createDataFrame([(0, "GATTACA"), (1, "TAG")], "read_id long, seq string")
    found = suffix.bwt(suffix.suffix_order(reads, Scratch(spark)), reads)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and found.where("symbol IS NULL").count() == 2


def test_equal_ranges_are_counted_once(spark):
    order = spark.createDataFrame([(k, k % 3, k) for k in range(30)], "sa_idx long, read_id long, pos long")
    ranges = spark.createDataFrame([(q, 2, 9) for q in range(500)] + [(500, 1, 0)], "query_id long, sp long, ep long")
    assert backward._reads_of(ranges, order).count() == 3
    assert rows(backward.count_for(ranges, order), "query_id", "q2", "q4") == sorted([(q, 3, 8) for q in range(500)] + [(500, 0, 0)], key=str)
    assert rows(backward.report_reads(ranges, order), "query_id", "read_id", "last_pos") == sorted([(q, r, p) for q in range(500) for r, p in ((0, 9), (1, 7), (2, 8))], key=str)


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_pairs_of_equal_ranges_are_not_shuffled(spark, monkeypatch, most):
    """range_report_reads and range_report_occurrences shuffled each query with each block of its range."""
    monkeypatch.setattr(backward, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(backward, "BLOCK", 4)
    order = spark.createDataFrame([(k, k % 7, k) for k in range(60)], "sa_idx long, read_id long, pos long")
    asked = [(q, *[(2, 39), (5, 5), (0, 59), (1, 0)][q % 4]) for q in range(90)] + [(None, 5, 5)]
    ranges = spark.createDataFrame(asked, "query_id long, sp long, ep long")
    want = [(q, k % 7, k) for q, a, b in asked for k in range(a, b + 1)]
    assert rows(backward.report_occurrences(ranges, order), "query_id", "read_id", "pos") == sorted(want, key=str)
    last = {}
    for q, r, p in want:
        last[q, r] = max(p, last.get((q, r), 0))
    found = backward.report_reads(ranges, order)
    assert rows(found, "query_id", "read_id", "last_pos") == sorted(((*k, p) for k, p in last.items()), key=str)
    if most:
        for each in (found, backward.report_occurrences(ranges, order)):
            plan = each._jdf.queryExecution().executedPlan().toString()
            # The lists of queries are broadcast and put out as the last step, after all shuffles.
            assert "Generate inline" in plan and plan.index("Generate inline") < plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")


def test_short_ranges_need_no_tree(spark):
    """Ranges of few rows, for each row, meet these alone; nodes of the tree are built for wide ones only."""
    tree = SymbolTree(spark.createDataFrame([(i, i % 7) for i in range(2000)], "i long, c long"), Scratch(spark))
    asked = spark.createDataFrame([(q, q, q + q % 50, 2, 3) for q in range(-5, 2000)], "query_id long, first long, last long, least long, most long")
    want = [(q, i, i % 7) for q in range(-5, 2000) for i in range(max(q, 0), min(q + q % 50, 1999) + 1) if i % 7 in (2, 3)]
    assert rows(tree.rows(asked), "query_id", "i", "c") == sorted(want, key=str)
    assert "tree" not in vars(tree)


def test_sparse_lookups_sort_once(spark, monkeypatch):
    """No tree: queries and ones are numbered together."""
    monkeypatch.setattr(ranktree, "RankTree", None)
    ones, asked = spark.createDataFrame([(3,), (10**15,)], "i long"), spark.createDataFrame([(0, 3), (1, 4), (2, 10**15 + 1)], "query_id long, v long")
    assert rows(sparse_lookup(ones, asked, Scratch(spark)), "query_id", "v", "rank", "idx", "i") == sorted([(0, 3, 1, 0, 3), (1, 4, 1, 1, 10**15), (2, 10**15 + 1, 2, 2, None)], key=str)
