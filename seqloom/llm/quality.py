"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's character classes and its use of a language's common words are two histograms. Each
is compared with its language's by the Jensen-Shannon distance (base 2, so 0 to 1); a document
that is too far from its language is dropped. A histogram of few items is no evidence: below a
least number of characters or words it isn't judged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, Scratch, column

#: Character classes that are counted beside blanks, as bodies of bracket expressions; all other characters
#: are the last class, small letters mostly. No character is in two of them.
CLASSES = {"digits": r"\p{N}", "capitals": r"\p{Lu}", "stops": r".,;:!?'\"()\-", "symbols": r"#*$%&|<>@=+~^_/\\{}\[\]`"}
#: The symbols of the base rules.
SYMBOLS = r"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """common: words of a language's histogram. A class histogram is judged from min_chars characters
    on, a word histogram from min_words words on; each passes up to its distance. That of words has
    to be below what a document without any common word has (on sf0.1 0.43 to 0.46 by language), and
    above what most of a language's own documents have (0.9 quantiles there: 0.27 to 0.30)."""

    common: int = 64
    min_chars: int = 200
    min_words: int = 80
    class_distance: float = 0.3
    word_distance: float = 0.36


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def base_measures(text: Column, words: Column, hashes: Column, marked: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, by its words, the
    hashes of their windows of three, and its characters of CLASSES.

    Repeats are found within the row: hashes of the word windows are sorted with their positions,
    so equal ones stand side by side; each repeated window covers its words up to the next one.
    Two different windows of a text are taken for equal with a probability of 2^-64.
    """
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def twins(order: Column) -> Column:
        kept = F.filter(order, lambda x, k: (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]))
        return let(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, twins)).otherwise(0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _of(marked, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    }


def windows_of(words: Column) -> Column:
    """Hashes of each three words in turn."""
    at = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _of(text: Column, characters: str) -> Column:
    """How many characters of a text are in the bracket expression."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")


def marked_of(text: Column) -> Column:
    """The characters of CLASSES alone: one pass over the text, so that each class is counted in a
    short rest of it."""
    return F.regexp_replace(text, f"[^{''.join(CLASSES.values())}]+", "")


#: Parts into which the words of a language are dealt to find the most frequent ones.
SALTS = 32


def common_words(docs: DataFrame, scratch: Scratch, limits: Limits, *, text_col: str, lang_col: str) -> DataFrame:
    """A row for each language, and one for all documents (lang null): the limits.common most
    frequent words of lower-cased texts, ties by code point, and their shares of all words.

    All documents count. Words are added up before the shuffle; a language's words are dealt to
    SALTS parts, and its most frequent ones are among those of the parts.
    """
    words = docs.select(column(lang_col).alias("lang"), F.explode(words_of(F.lower(column(text_col)))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = scratch.keep(words, "words")
    every = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    words = words.where("lang IS NOT NULL").unionByName(every)

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where(F.col("place") <= limits.common)

    salted = first(words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS))), "lang", "salt").drop("salt")
    ranked = first(salted, "lang")
    common = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    joined = common.alias("c").join(totals.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")))
    out = joined.select(F.col("c.lang").alias("lang"), F.transform("top", lambda x: x["word"]).alias("common"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("shares"))
    return scratch.keep(out, "common")


def _term(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence, base 2."""
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return (half(p) + half(q)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def class_distance(counts: Column, shares: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    return let(whole, lambda n: _distance(_total(F.zip_with(counts, shares, lambda c, q: _term(c / n, q)))))


def word_distance(words: Column, common: Column, shares: Column, known: list[str] | None = None) -> Column:
    """Of the histogram of words: the common words, and one bin of all others.

    Only the bins that the document has are visited: an absent one adds half its share. known are
    the common words of all languages, as a hash set: most words aren't among them.
    """
    low = F.transform(words, F.lower)
    found = F.transform(low if known is None else F.filter(low, lambda w: w.isin(known)), lambda w: F.array_position(common, w).cast("int"))

    def runs(order: Column, n: Column) -> Column:
        ends = F.filter(F.transform(order, lambda x, k: F.when(F.get(order, k + 1) == x, F.lit(0)).otherwise(k + 1)), lambda k: k > 0)
        return let(ends, lambda ends: bins(order, ends, n))

    def bins(order: Column, ends: Column, n: Column) -> Column:
        met = F.transform(ends, lambda e, k: F.struct((F.get(shares, F.get(order, e - 1) - 1)).alias("q"), ((e - F.coalesce(F.get(ends, k - 1), F.lit(0))) / n).alias("p")))
        present = _total(F.transform(met, lambda x: _term(x["p"], x["q"]) - x["q"] / 2))
        known = _total(shares)
        return _distance(known / 2 + present + _term(1 - F.size(order) / n, F.greatest(1 - known, F.lit(0.0))))

    places = F.sort_array(F.filter(found, lambda k: k > 0))
    return let(places, lambda order: let(F.greatest(F.size(words), F.lit(1)).cast("double"), lambda n: runs(order, n)))


#: Languages up to this number are broadcast with their references, and their common words are one set; more
#: are joined by a shuffle and looked up in their own language's words alone.
BROADCAST_LANGUAGES = 1_000


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), with_text: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance and kept.

    A document of under 50 words, or with over half of its words in repeated windows of three,
    fails the base rules. The others are kept unless a histogram that is long enough is too far
    from its language's. A null language is compared with all documents. A null or empty text has
    no words and fails; its distances are null. Rows that repeat others are judged, and count in the
    references, each for itself; an empty table gives no rows. Columns that are named like the
    results are replaced, all others stay. The measures are written to the shared folder once, with
    the rows: without with_text the text is left out there and in the result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    common = common_words(docs, scratch, limits, text_col=text_col, lang_col=lang_col)
    languages = common.count()
    few = languages <= BROADCAST_LANGUAGES
    known = sorted({w for x in common.select("common").collect() for w in x[0]}) if few else None
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    held = [c for c in docs.columns if c not in names and (with_text or c != text_col)]
    rows = docs.select(F.struct(*[column(c) for c in held]).alias("doc"), column(lang_col).alias("lang"), F.coalesce(column(text_col), F.lit("")).alias("text"))  # no name can clash
    joined = with_reference(rows, common, few).withColumn("words", words_of(F.col("text"))).withColumns({"hashes": windows_of(F.col("words")), "marked": marked_of(F.col("text"))})
    base = base_measures(F.col("text"), F.col("words"), F.col("hashes"), F.col("marked"))
    measured = joined.select("doc", "lang", *[x.alias(c) for c, x in base.items()], F.length("text").cast("long").alias("length"), *[_of(F.col("marked"), x).alias(c) for c, x in CLASSES.items()],
        F.when(F.size("words") > 0, word_distance(F.col("words"), F.col("ref.common"), F.col("ref.shares"), known)).alias("word_distance"))
    counts = [*[F.col(c) for c in CLASSES], F.col("length") - F.col("word_chars")]
    rest = F.col("length")
    for x in counts:
        rest = rest - x
    measured = scratch.keep(measured.withColumn("counts", F.array(*counts, rest)).drop(*CLASSES), "measured")
    shares = scratch.keep(class_shares(measured), "shares")
    judged = with_reference(measured, shares, few)
    judged = judged.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "class_distance": F.when(F.col("length") > 0, class_distance(F.col("counts"), F.col("ref.shares"))),
    })
    near = (F.col("length") < limits.min_chars) | (F.col("class_distance") <= limits.class_distance)
    alike = (F.col("n_words") < limits.min_words) | (F.col("word_distance") <= limits.word_distance)
    for name in ("words", "common"):
        scratch.drop(name)
    return judged.withColumn("kept", ~F.col("base_failed") & near & alike).select(*[column(c, "doc").alias(c) for c in held], *names)


def with_reference(rows: DataFrame, references: DataFrame, few: bool) -> DataFrame:
    """rows with ref, the row of references with their lang; that without a language if they have none."""
    refs = references.select(F.col("lang").alias("ref_lang"), F.struct(*[c for c in references.columns if c != "lang"]).alias("ref"))
    return rows.join(F.broadcast(refs) if few else refs, rows["lang"].eqNullSafe(refs["ref_lang"]), "left").drop("ref_lang")


def class_shares(measured: DataFrame) -> DataFrame:
    """lang and shares: of the characters of each language, and of all (lang null), those of each class."""
    n = len(CLASSES) + 2
    sums = measured.groupBy("lang").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(n)])
    sums = sums.where("lang IS NOT NULL").unionByName(sums.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]).select(F.lit(None).cast("string").alias("lang"), *[f"c{k}" for k in range(n)]))
    whole = sum((F.col(f"c{k}") for k in range(1, n)), F.col("c0"))
    return sums.select("lang", F.array(*[F.when(whole > 0, F.col(f"c{k}") / whole).otherwise(F.lit(0.0)) for k in range(n)]).alias("shares"))
