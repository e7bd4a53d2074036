"""Each operator against brute force, with nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import components, language, mixing, neighbours, quality, sharding, simhash, token_files, warc
from seqloom.llm.byte_bpe import ByteBpe, decode, encode
from seqloom.llm.common import Scratch, doc_key

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \n\t", "é", "日本語テキスト", "🙂👍🏽 don't we'll", "a" * 3000, "x\x85y\xa0z", "<|endoftext|>", "word, word. İ ΣΑΣ!"]


def docs_of(spark, texts, schema=DOCS, langs=("en",), sources=("s0", "s1", None)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], sources[i % len(sources)]) for i, t in enumerate(texts)], schema)


def some_texts(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randrange(1, 8))) for _ in range(80)]
    return [" ".join(draw.choice(words) + draw.choice(["", "", ",", ".\n"]) for _ in range(draw.randrange(120))) for _ in range(n)]


# 1 sharding


def test_table_is_filled_in_turns():
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    # by hand: each shard in turn takes the first free slot of its order
    want, free, at = [-1] * 101, 101, {k: 0 for k in range(3)}
    orders = {k: [(sharding._hash(f"s{k}", "start") + j * (sharding._hash(f"s{k}", "stride") % 100 + 1)) % 101 for j in range(101)] for k in range(3)}
    while free:
        for k in range(3):
            if free:
                while want[orders[k][at[k]]] >= 0:
                    at[k] += 1
                want[orders[k][at[k]]] = k
                free -= 1
    assert sharding.fill_table(names[:3], 101) == want


def test_few_keys_move_when_a_shard_goes():
    before, after = sharding.fill_table([f"s{k}" for k in range(10)], 10007), sharding.fill_table([f"s{k}" for k in range(9)], 10007)
    moved = sum(a != b for a, b in zip(before, after) if a != 9)
    assert moved < 0.2 * 10007


def test_weights_and_errors():
    counts = Counter(sharding.fill_table(["a", "b"], 1009, [3, 1]))
    assert abs(counts[0] / counts[1] - 3) < 0.05
    for bad in (lambda: sharding.fill_table([]), lambda: sharding.fill_table(["a", "a"]), lambda: sharding.fill_table(["a"], 100)):
        with pytest.raises(ValueError):
            bad()


def test_place(spark):
    df = docs_of(spark, ["x", None, "", "x"]).withColumn("slot", F.lit("old")).withColumn("_shard_at_", F.lit(1))
    placed = sharding.place(df, doc_key(F.col("doc_id"), F.col("text")), ["a", "b", "c"], slots=101)
    assert placed.count() == 4 and set(placed.columns) == {*df.columns, "shard"}
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert all("abc"[table[x.slot]] == x.shard for x in placed.collect())
    one = sharding.place(df, F.lit(None).cast("string"), ["a", "b"])
    assert one.select("shard").distinct().count() == 1
    assert sharding.place(df.limit(0), F.col("doc_id"), ["a"]).count() == 0


# 2 nearest neighbours


def brute_neighbours(rows, nearest=5):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % 50 == 0:
            scores = [(-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in usable if j != i]
            out[i] = sorted((round(s, 12), j) for s, j in scores)[:nearest]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = (centres[draw.integers(12, size=700)] + 0.3 * draw.normal(size=(700, 16))).astype(np.float32).tolist()
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16
    for k in range(100, 140):
        vectors[k] = vectors[100]  # many equal candidates: the smallest ids win
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    want, got = brute_neighbours(list(enumerate(vectors))), {}
    for x in sorted(found, key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append((round(-x.score, 12), x.vec_id))
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [j for _, j in got[100]] == [j for _, j in want[100]] == [101, 102, 103, 104, 105]


def test_neighbours_do_not_depend_on_layout(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 300)
    draw = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(3000, 24)).astype(np.float32).tolist())]
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(n)
            found.append(sorted(map(tuple, neighbours.search(df, F.col("vec_id") % 50 == 0, reranked=8).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 60 * 5
    want = brute_neighbours(rows)
    assert sum(j in {x for _, x in want[q]} for q, _, j, _ in found[0]) >= 0.9 * len(found[0])


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (0, [1.0, 0.0]), (None, [1.0, 0.0])], schema)
    assert [(x.query_id, x["rank"], x.vec_id) for x in neighbours.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert neighbours.search(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


# 3 language


def test_language(spark):
    draw = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "äöüß"}
    rows = []
    for i in range(300):
        lang = draw.choice(list(alphabets))
        rows.append((i, " ".join("".join(draw.choice(alphabets[lang]) for _ in range(4)) for _ in range(30)), lang, None))
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old"))
    model = language.fit(df, F.col("doc_id") % 5 != 0)
    found = language.predict(df, model)
    assert set(found.columns) == {*df.columns, "lang_pred"}
    held = found.where("doc_id % 5 = 0").collect()
    assert sum(x.lang == x.lang_pred for x in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in held)
    odd = language.predict(docs_of(spark, [*ODD, "123 !?"]), model).orderBy("doc_id").collect()
    assert [x.lang_pred for x in odd[:3]] == ["und"] * 3 and odd[-1].lang_pred == "und" and all(x.lang_pred != "und" for x in odd[3:-1])
    none = language.fit(df.limit(0), F.lit(True))
    assert {x.lang_pred for x in language.predict(df, none).collect()} == {"und"}


def test_unseen_words_fall_back():
    known = {"ab": 0}
    table = np.array([[1.0, -1.0]], np.float32)
    grams = [({}, table)] * 5
    grams[3] = ({"xy": 0}, -table)
    model = language.Model(["p", "q"], (known, table), grams)
    assert model.word_scores("ab").tolist() == [1, -1] and model.word_scores("axyb").tolist() == [-1, 1] and model.word_scores("zz").tolist() == [0, 0]


# 4 quality


def base_brute(text):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    three = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
    kept = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(kept) - len(set(kept)), len(covered)


def divergence(p, q):
    half = lambda a, b: a * np.log2(2 * a / (a + b)) if a > 0 else 0.0
    return np.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2))


def test_quality(spark):
    draw = random.Random(6)
    common = ["the", "of", "and", "to", "in", "is"]
    clean = [" ".join(draw.choice(common) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(150)) for _ in range(60)]
    junk = [" ".join("".join(draw.choice("#*$%&|<>0123456789") for _ in range(7)) for _ in range(150)) for _ in range(3)]
    texts = [*clean, *junk, *ODD, "a b c a b c\n\nx\nx", "a a a a", "one two"]
    df = docs_of(spark, texts, langs=("en", None)).withColumn("n_words", F.lit(-1))
    limits = quality.Limits()
    found = {x.doc_id: x for x in quality.judge(df, limits=limits).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        x = found[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_brute(text)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
    assert all(found[i].kept for i in range(60)) and not any(found[i].kept for i in range(60, len(texts)))
    # the word histogram of one document against its language's
    mine = [t for i, t in enumerate(texts) if i % 2 == 0 and t]
    counts = Counter(w for t in mine for w in quality_words(t))
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: limits.common]
    own = Counter(quality_words(texts[0]))
    p = [own[w] / sum(own.values()) for w in top]
    q = [counts[w] / sum(counts.values()) for w in top]
    assert abs(found[0].word_distance - divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)])) < 1e-9
    assert quality.judge(df.limit(0)).count() == 0


def quality_words(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]


# 6 near-duplicates


def fingerprint_brute(text):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(x, seed=42) for x in parts]
    return sum((2 * sum(v >> b & 1 for v in values) > len(values)) << b for b in range(64)) if values else 0


def test_fingerprints():
    for text in [*ODD, *some_texts(30), "one", "One two", "a b c " * 400]:
        assert simhash.fingerprint(text) == fingerprint_brute(text)


def groups_brute(points, bits=3):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(simhash.distance(points[:i], points[i]) <= bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def clustered(n, seed):
    """Chains and dense balls of fingerprints, and many that stand alone."""
    draw = random.Random(seed)
    points = {draw.getrandbits(64) for _ in range(n)}
    for x in list(points)[: n // 10]:
        for _ in range(draw.randrange(12)):
            for _ in range(draw.randrange(1, 4)):
                x ^= 1 << draw.randrange(64)
            points.add(x)
    return np.array(sorted(points), dtype=np.uint64)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_lose_no_link(seed):
    points = clustered(3000, seed)
    links = simhash.link(points, np.arange(len(points)), np.arange(0), 3)
    roots, want = links.roots(np.arange(len(points))), groups_brute(points)
    assert len(set(zip(roots.tolist(), want))) == len(set(want)) == len(set(roots.tolist()))


@pytest.mark.parametrize("task_rows", [400_000, 100])
def test_sharded_links(spark, monkeypatch, task_rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    monkeypatch.setattr(simhash, "TASK_ROWS", task_rows)
    points = clustered(4000, 3)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fingerprint long")
    scratch = Scratch(spark, "test")
    found = components.connected(simhash.fingerprint_links(df, scratch), scratch)
    roots = {x.node: x.root for x in found.collect()}
    want = groups_brute(points)
    mine = [roots.get(int(x), int(x)) for x in points.view(np.int64)]
    assert len(set(zip(mine, want))) == len(set(want)) == len(set(mine))


def test_near_duplicates(spark):
    texts = some_texts(40)
    texts += [texts[3], texts[3], None, "", "\t", texts[5] + " "]
    df = docs_of(spark, texts).withColumn("fingerprint", F.lit("old"))
    points = np.array([fingerprint_brute(x) for x in texts], dtype=np.uint64)
    want = groups_brute(points)
    found = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    assert {i: (found[i].fingerprint & (1 << 64) - 1, found[i].component_id) for i in found} == {i: (int(points[i]), want[i]) for i in range(len(texts))}
    kept = simhash.deduplicate(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(df).collect()), key=str) == sorted([(7, "a b c d"), (None, "q r s t u")], key=str)


def test_components(spark):
    draw = random.Random(9)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(300)] + [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = components.connected(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test"))
    alone = {x for x in parent if sum(find(y) == find(x) for y in parent) == 1}
    assert {x.node: x.root for x in found.collect()} == {x: find(x) for x in parent if x not in alone}
    assert components.connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# 7 archives


def test_archive_round_trip(spark):
    big, small = "x" * 200, "y" * 20
    rows = [(5, "http://a/ b", big), (3, None, big), (9, "http://c", big + "z"), (4, "u", small), (6, "u", small), (7, "", None), (3, "dup", big), (8, "é", "日本\r\n\r\n語" * 40), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0))
    found = warc.archive_round_trip(spark, pages).collect()
    assert len(found) == len(rows)
    for x in found:
        assert any(k == x.key and hashlib.sha256((t or "").encode()).hexdigest() == x.payload_digest and len((t or "").encode()) == x.payload_bytes for k, _, t in rows)
    of_big = [x for x in found if x.payload_digest == hashlib.sha256(big.encode()).hexdigest()]
    assert [x.record_type for x in sorted(of_big, key=lambda x: (x.record_type, str(x.key)))] == ["response", "revisit", "revisit", "revisit"]
    assert {x.refers_to for x in of_big if x.record_type == "revisit"} == {3} and [x.key for x in of_big if x.record_type == "response"] == [3]
    assert all(x.record_type == "response" and x.refers_to is None for x in found if x.payload_bytes < 100)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [True, False])
def test_arc_records(version, zipped):
    records = [("http://a/x y", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://b 1 2 3 4"), ("dns:a", "text/dns", b""), ("http://c", "text/plain", b"\n\n")]
    data = warc.arc_file("f.arc", version, "20010203040506", records)
    if not zipped:
        data = b"".join(x for _, x in warc.members(data))
    found = list(warc.arc_records("f.arc", data))
    assert [(x.version, x.fields["URL"], x.fields["Content-type"], x.content, x.truncated) for x in found] == [(version, *x, False) for x in records]
    (fields, block), *_ = warc.warc_records(warc.warc_record(found[0]))
    assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "2001-02-03T04:05:06Z" and block == records[0][2]
    assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(records[0][2].split(b"\r\n\r\n", 1)[1]).hexdigest()
    assert list(warc.warc_records(warc.warc_record(found[1])))[0][0]["WARC-Type"] == "resource"
    assert warc.record_id("f.arc", 5) == warc.record_id("f.arc", 5) != warc.record_id("f.arc", 6)


def test_arc_damage():
    data = b"".join(x for _, x in warc.members(warc.arc_file("f", 1, "20010203040506", [("http://a", "t/h", b"12345")])))
    assert [x.truncated for x in warc.arc_records("f", data[:-4])] == [True]
    with pytest.raises(ValueError):
        list(warc.arc_records("f", data + b"no header\n"))
    assert [warc.iso_date(x) for x in ("2001", "200102030405", "x")] == ["2001-01-01T00:00:00Z", "2001-02-03T04:05:00Z", "1970-01-01T00:00:00Z"]


# 8 mixing


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: weights[k % 3] for k, x in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[x] for x in open_)
        over = {x for x in open_ if unit * weight[x] > cap * sizes[x]}
        if not over:
            return target | {x: unit * weight[x] for x in open_}
        for x in over:
            target[x] = cap * sizes[x]
            left -= target[x]
        open_ -= over
    return target


def test_mixing(spark):
    texts = some_texts(400)
    df = docs_of(spark, texts, sources=("b", "a", None, "ä", "c", "empty", "a", "a")).withColumn("size", F.lit("old"))
    df = df.withColumn("text", F.when(F.col("source") == "empty", F.lit(None).cast("string")).otherwise(F.col("text")))
    rows = mixing.mix(df).collect()
    sizes = Counter()
    for x in rows:
        sizes[x.source] += x.size
    want = targets_brute(dict(sizes))
    assert len(rows) == 400
    taken = Counter()
    for x in rows:
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, x.target) and x.source_size == sizes[x.source]
        assert x.copies in ({int(x.rate), int(x.rate) + 1}) and x.taken == x.copies * x.size <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 60 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
    emitted = Counter(x.doc_id for x in mixing.emit(df).collect())
    assert emitted == Counter({x.doc_id: x.copies for x in rows if x.copies}) and mixing.emit(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.emit(df.limit(0)).count() == 0


# 9 byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def ids_of(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_bpe_is_the_librarys(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    draw = random.Random(1)
    texts = [x or "" for x in ODD] + some_texts(20) + ["".join(draw.choice("abcde éñ\n日 '") for _ in range(draw.randrange(300))) for _ in range(200)] + ["".join(draw.choice("aeiounth") for _ in range(draw.randrange(1, 400))) for _ in range(100)]
    got = [ids_of(x) for x in bpe.encode(texts)]
    assert got == [library.encode_ordinary(x) for x in texts]
    assert [bpe.decode(x) for x in got] == [x.encode() for x in texts]
    for n in (1, 2, 3, 63, 64, 65):
        piece = "".join(draw.choice("then") for _ in range(n)).encode()
        assert bpe.merge_long(piece) == library.encode_ordinary(piece.decode())  # letters alone are one piece


def test_bpe_frames(spark):
    options = {"vocabulary": tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": tokenizers.PATTERN}
    df = docs_of(spark, ODD).withColumn("ids", F.lit("old"))
    coded = encode(df, **options)
    found = decode(coded, **options).collect()
    assert set(coded.columns) == set(df.columns) and [bytes(x.decoded).decode() for x in sorted(found)] == [x or "" for x in ODD]
    assert encode(df.limit(0), **options).count() == 0


# 10 token files


@pytest.mark.parametrize("kind", range(3))
def test_simple8b(kind):
    draw = random.Random(kind)
    widths = [[0, 0, 1, 2, 3], [5, 7, 8, 10, 12, 15, 20], [0, 1, 15, 30, 60, 61, 64]][kind]
    for _ in range(100):
        ids = np.array([draw.getrandbits(draw.choice(widths)) for _ in range(draw.randrange(500))], dtype=np.uint64)
        words = token_files.pack(ids)
        assert (token_files.unpack(words) == ids).all()
    zeros = np.zeros(1000, np.uint64)
    assert len(token_files.pack(zeros)) == 8 + 2  # 8 words of 120, the other 40 in 30 and 10 or fewer words yet
    file = token_files.TokenFile(token_files.to_file([5, None], [3, 200_000], np.arange(200_003, dtype=np.uint32)))
    assert file.doc_ids == [5, None] and len(file.offsets) == 4 and file.block(3)[0] == 3 * token_files.BLOCK


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + some_texts(30)
    df = docs_of(spark, texts).unionByName(spark.createDataFrame([(None, "no id", None, None), (3, "a twin", None, None)], DOCS)).withColumn("ids", F.lit(1))
    scratch = Scratch(spark, "test")
    manifest = scratch.keep(token_files.write(df, scratch.path("f"), vocabulary=path, end_id=2, file_ids=200), "manifest")
    found = sorted(token_files.read(spark, scratch.path("f"), manifest).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in found] == [None, *sorted([*range(len(texts)), 3])]
    at = 0
    for x in found:
        assert x.start == at
        at += x.n_tokens
    want = {(i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in [*enumerate(texts), (None, "no id"), (3, "a twin")]}
    assert {(x.doc_id, tuple(x.ids)) for x in found} == want
    digests = {x.start: x.digest for x in token_files.read(spark, scratch.path("f"), manifest, digest=zlib.crc32).collect()}
    assert digests == {x.start: zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in found}
    empty = scratch.keep(token_files.write(df.limit(0), scratch.path("e"), vocabulary=path, end_id=2), "none")
    assert empty.count() == 0
