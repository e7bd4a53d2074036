"""Language identification against a brute-force version of the model and the scores."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from seqloom.llm import language

SCHEMA = "doc_id long, text string, lang string"
ODD = [None, "", " \n\t", "123 !?", "ΣΑΣ Σ", "İstanbul x̃y", "日本語テキスト", "🙂 don't", "ＦＵＬＬ ﬁ ẞ"]


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}]+", text.lower()) if text and regex.search(r"\p{L}", text) else []


def brute(rows):
    """score(text) of a model of all labelled rows: log frequencies with half a count added, centred
    over the languages; unseen words by their longest known n-grams."""
    labelled = [(t, x) for _, t, x in rows if t is not None and x is not None]
    languages = sorted({x for _, x in labelled})
    counts = Counter((x, w) for t, x in labelled for w in words_of(t))

    def logs(pairs):
        table = defaultdict(lambda: [0] * len(languages))
        for (x, key), n in pairs.items():
            table[key][languages.index(x)] += n
        totals = [sum(v[k] for v in table.values()) for k in range(len(languages))]
        out = {}
        for key, v in table.items():
            found = [math.log((n + 0.5) / (t + 0.5 * len(table))) for n, t in zip(v, totals)]
            out[key] = [y - sum(found) / len(found) for y in found]
        return out

    known, grams = logs(counts), {}
    for size in (5, 4, 3, 2, 1):
        pairs = Counter()
        for (x, w), n in counts.items():
            marked = f"<{w}>"
            for k in range(len(marked) - size + 1):
                pairs[x, marked[k : k + size]] += n
        grams[size] = logs(pairs)

    def of_word(word):
        if word in known:
            return known[word]
        marked = f"<{word}>"
        for size in (5, 4, 3, 2, 1):
            hits = [grams[size][marked[k : k + size]] for k in range(len(marked) - size + 1) if marked[k : k + size] in grams[size]]
            if hits:
                return np.mean(hits, axis=0)
        return [0.0] * len(languages)

    def score(text):
        words = words_of(text)
        if not words:
            return {}
        mean = np.mean([of_word(w) for w in words], axis=0)
        odds = np.exp((mean - mean.max()) * min(len(words), 8))
        return dict(zip(languages, odds / odds.sum()))

    return score


@pytest.mark.parametrize("remembered", [250_000, 20])
def test_fit_and_predict(spark, monkeypatch, remembered):
    monkeypatch.setattr(language, "REMEMBERED", remembered)
    draw = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "cdefgh", "cc": "aeäöüßÉ", None: "xyz"}
    one = lambda x: " ".join("".join(draw.choice(alphabets[x]) for _ in range(draw.randrange(1, 7))) for _ in range(draw.randrange(1, 25)))
    rows = [(i, one(x), x) for i in range(150) for x in [draw.choice(list(alphabets))]]
    rows += [(150, None, "aa"), (151, "", "bb"), (3, *rows[3][1:]), (3, *rows[3][1:]), (None, "abcd", "aa")]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True), train_docs=10**6)
    unseen = [(1000 + i, one(draw.choice(list(alphabets))) + draw.choice(["", " Q", " 7 ΩΩ"]), None) for i in range(60)] + [(2000 + i, t, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([*rows, *unseen], SCHEMA).withColumn("word", F.lit(1))
    score = brute(rows)
    found = language.predict(df, model).collect()
    assert len(found) == len(rows) + len(unseen)
    for x in found:
        want = score(x.text)
        assert x.word == 1
        if not want:
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            assert abs(x.score - max(want.values())) < 1e-5 and want[x.lang_pred] > max(want.values()) - 1e-5


def test_very_long_words_are_not_remembered():
    nothing = ({}, np.zeros((0, 2), np.float32))
    scorer = language.Scorer(language.Model(["p", "q"], ({"ab": 0}, np.array([[1.0, -1.0]], np.float32)), [nothing] * 5))
    long = "x" * 300_000
    assert scorer.score(["ab", long, f"ab {long}"])[0][0] == "p" and set(scorer.rows) == {"ab"}
