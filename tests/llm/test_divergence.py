"""The audit against plain counting, and the odd cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import divergence
from seqloom.llm.divergence import audit, shares

SCHEMA = "text string, lang string, source string"


def plain(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        of = {s: {w: p(counts[lang, s][w], total[s]) for w in kept} for s in sources}
        whole = {w: p(sum(counts[lang, s][w] for s in sources), sum(total.values())) for w in kept}
        for s in sources:
            pairs = [(-sum(abs(of[s][w] - of[t][w]) for w in kept), t.encode()) for t in sources if t != s]
            terms = [(whole[w] - of[s][w], w.encode()) for w in kept if counts[lang, s][w] and of[s][w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -value, rank) for rank, (value, x) in enumerate(found, 1)]
    return sorted(out)


def some_rows(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcXYé日🙂") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    sources = ["hot"] * 8 + ["a", "b", "é", "🙂", None, ""]
    rows = [(" ".join(draw.choices(words, weights=range(60, 0, -1), k=draw.randrange(30))) + draw.choice([".", "\n", " 12-3_"]), draw.choice(["en", "en", "de", None]), draw.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "silent"), ("", "rare", "x"), ("one two", "rare", "y"), (None, None, None), ("w" * 50_000 + " end", "en", "a"), ("q " * 50_000, "en", "b")]


@pytest.mark.parametrize("seed,least,top,cells,tile", [(1, 30, 50, 4_000_000, 512), (2, 3, 4, 40, 2), (3, 1, 1000, 7, 3)])
def test_equals_plain_counting(spark, monkeypatch, seed, least, top, cells, tile):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = some_rows(250, seed)
    found = audit(spark.createDataFrame(rows, SCHEMA), least_documents=least, top=top)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, least, top)


def test_equal_columns_are_one(spark):
    rows = [(f"a{'b' * (k % 20)}", "en", f"s{k % 2}") for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in audit(docs, least_documents=2).collect()) == plain(rows, 2, 50)


def test_shares_of_huge_counts():
    n, total = np.array([5, 7 * 10**14, 9 * 10**14]), np.array([9 * 10**14])
    assert shares(n, total).tolist() == [1 + 10**9 * int(x) // (9 * 10**14) for x in n]


def test_empty_table_and_names(spark):
    docs = spark.createDataFrame([("a b", "en", "s", 1)], "body string, term string, n string, found int")
    assert audit(docs.limit(0), text_col="body", lang_col="term", source_col="n").count() == 0
    assert audit(docs, text_col="body", lang_col="term", source_col="n", least_documents=1).count() == 0  # one source
