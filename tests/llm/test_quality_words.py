"""Quality rules reject documents that have none of their language's common words."""

import random

import pytest

from seqloom.llm import quality

COMMON = {"en": ["the", "of", "and", "to", "in", "is"], "de": ["der", "und", "die", "das", "ist", "von"]}


@pytest.mark.parametrize("kind", ["another language", "invented words"])
def test_documents_without_common_words_go(spark, kind):
    draw = random.Random(9)
    rare = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 7)))
    prose = lambda words: " ".join(draw.choice(words) if draw.random() < 0.33 else rare() for _ in range(150))
    rows = [(i, prose(COMMON[lang]), lang) for i, lang in enumerate(["en", "de"] * 60)]
    bad = prose(COMMON["de"]) if kind == "another language" else " ".join(rare() for _ in range(150))
    found = {x.doc_id: x for x in quality.judge(spark.createDataFrame([*rows, (120, bad, "en")], "doc_id long, text string, lang string"), limits=quality.Limits(common=6)).collect()}  # so few texts have no 64 common words
    assert not found[120].base_failed and not found[120].kept
    assert quality.Limits().word_distance < found[120].word_distance < 0.5  # the former limit kept it
    assert all(found[i].kept for i in range(120))


@pytest.mark.parametrize("broadcast", [1_000, 0])
def test_classes_of_all_scripts_and_names_that_clash(spark, monkeypatch, broadcast):
    """Digits and capitals of any script are their classes; other columns stay, repeated rows are judged each for itself."""
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", broadcast)
    draw = random.Random(2)
    prose = lambda: " ".join(draw.choice(COMMON["en"]) if draw.random() < 0.4 else "".join(draw.choice("abcdéж") for _ in range(5)) for _ in range(120))
    odd = {k: " ".join("".join(draw.choice(x) for _ in range(6)) if n % 3 else "the of" for n in range(120)) for k, x in enumerate(["٠١٢٣४५६७", "ЖЁÄÖÉЙ", "@=+~^_/\\{}[]`"])}
    rows = [(i, prose(), "en", "w", 1) for i in range(40)] + [(50 + k, t, "en", "w", 1) for k, t in odd.items()]
    rows += [(40, rows[0][1], "en", "w", 1), (40, rows[0][1], "en", "w", 1), (41, "", "none", "w", 1), (42, None, None, "w", 1), (43, prose(), None, "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, `a.b` int")
    found = quality.judge(df, limits=quality.Limits(common=6))
    assert found.columns[:5] == df.columns
    got = {}
    for x in found.collect():
        got.setdefault(x.doc_id, []).append(x)
    assert len(got[40]) == 2 and got[40][0].asDict() == got[40][1].asDict() and got[40][0].words == "w" and got[40][0]["a.b"] == 1 and got[40][0].text == rows[0][1]
    assert all(got[i][0].kept for i in range(40)), [(x[0].class_distance, x[0].word_distance) for x in got.values()]
    assert all(not got[50 + k][0].kept and got[50 + k][0].class_distance > quality.Limits().class_distance for k in odd)
    assert got[41][0].class_distance is None and got[42][0].word_distance is None and not got[41][0].kept and got[43][0].kept
    slim = quality.judge(df, with_text=False)
    assert "text" not in slim.columns and slim.count() == len(rows) and quality.judge(df.limit(0)).count() == 0
