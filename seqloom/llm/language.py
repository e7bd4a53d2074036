"""Language identification, words first.

A known word scores each language by the logarithm of its frequency there. An unseen word falls
back on its character n-grams: the longest length of which the model knows any gives the score,
else the next shorter one.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import Scratch, column, doc_key, small_batches, task, worker_state

LETTERS = r"[\p{L}\p{M}]+"
UNKNOWN = "und"
#: Documents per language that the model learns from, about; picked by a hash. The model has all of their
#: words and n-grams, so this bounds its size.
TRAIN_DOCS = 1500
GRAM_SIZES = (5, 4, 3, 2, 1)
#: Words of evidence behind a score: a longer text counts as one of this length.
EVIDENCE = 8
#: Words that a Python worker remembers the scores of, and the most letters of one.
REMEMBERED, REMEMBERED_LETTERS = 250_000, 64
#: Characters that are scored at a time.
SLICE = 1_000_000


class Words:
    """The words of a text: runs of letters and marks in lower case. A text without a letter has none."""

    def __init__(self) -> None:
        import regex

        self.letters, self.letter = regex.compile(LETTERS), regex.compile(r"\p{L}")

    def of(self, text: str | None) -> list[str]:
        return self.letters.findall(text.lower()) if text and self.letter.search(text) else []


@dataclass
class Model:
    """languages in the order of their code points; for words and for n-grams of each size, where
    in the table their log frequencies stand, a column for each language."""

    languages: list[str]
    words: tuple[dict[str, int], np.ndarray]
    grams: list[tuple[dict[str, int], np.ndarray]]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, word: str) -> np.ndarray:
        """A word's score for each language; zeros if nothing of it is known."""
        known, table = self.words
        found = known.get(word)
        if found is not None:
            return table[found]
        marked = f"<{word}>"
        for size, (known, table) in zip(GRAM_SIZES, self.grams):
            hits = [x for k in range(len(marked) - size + 1) if (x := known.get(marked[k : k + size])) is not None]
            if hits:
                return table[hits].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def _log_frequencies(counts: DataFrame, key: str, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The keys of counts(lang, key, n), and each one's log frequency by language, centred."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{k}") for k, x in enumerate(languages)]
    found = counts.groupBy(key).agg(*each).orderBy(key).toArrow()  # what the sampled documents have
    table = np.stack([np.nan_to_num(found.column(f"n{k}").to_numpy().astype(np.float64)) for k in range(len(languages))], axis=1)
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(table))))
    return {x: k for k, x in enumerate(found.column(key).to_pylist())}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents of docs for which learnable is true.

    About train_docs whole documents of each language are learned from, picked by a hash of their
    id; rows that repeat a document are picked together and count each for itself. Null texts and
    labels are left out; without any labels, as in an empty table, the model knows no language.
    """
    text, lang = column(text_col), column(lang_col)
    used = docs.where(learnable & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(doc_key(column(id_col), text), F.lit("train")).alias("draw"))
    sizes = used.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(x["lang"] for x in sizes)
    if not languages:
        nothing = {}, np.zeros((0, 0), np.float32)
        return Model([], nothing, [nothing] * len(GRAM_SIZES))
    parts = 1 << 30
    share = F.create_map(*[y for x in sizes for y in (F.lit(x["lang"]), F.lit(min(parts, int(parts * train_docs / x["count"]) + 1)))])
    sample = used.where(F.pmod("draw", F.lit(parts)) < F.element_at(share, F.col("lang")))

    @task
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state("words of languages", Words)
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((x, w) for w in words.of(text))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in counts], pa.string()), "word": pa.array([w for _, w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})

    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "language")
    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words, "words")
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = []
    for size in GRAM_SIZES:
        starts = F.when(F.length(marked) >= size, F.sequence(F.lit(1), F.length(marked) - size + 1))
        # Not by transform(): a function of two parameters would be given the index as the second.
        cut = words.select("lang", "n", marked.alias("marked"), F.explode(starts).alias("k")).select("lang", "n", F.substring("marked", F.col("k"), F.lit(size)).alias("gram"))
        grams.append(_log_frequencies(cut.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", languages))
    model = Model(languages, _log_frequencies(words, "word", languages), grams)
    scratch.drop()
    return model


class Scorer:
    """Scores texts by a model; remembers words."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = [self.words.of(x) for x in texts]
        if len(self.table) > REMEMBERED:
            self._forget()
        new = list(set().union(*found).difference(self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, np.stack([self.model.word_scores(x) for x in new])])
        out = self._mean(found)
        for x in new:
            if len(x) > REMEMBERED_LETTERS:
                del self.rows[x]
        return out

    def _mean(self, found: list[list[str]]) -> list[tuple[str, float]]:
        languages = self.model.languages
        out = []
        for words in found:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
            mean = self.table[at].mean(axis=0, dtype=np.float64)
            odds = np.exp((mean - mean.max()) * min(len(words), EVIDENCE))
            best = int(odds.argmax())
            out.append((languages[best], float(odds[best] / odds.sum())))
        return out


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language of whole texts and its score, 0 to 1.

    The score is the language's share of the likelihood, given the text's mean evidence by word
    over at most EVIDENCE words. Null texts and those without a letter are `und` with score 0, as
    are all if the model knows no language; of languages with equal scores the first is taken.
    Columns that are named like the results are replaced, all others stay. Each row is scored for
    itself, so repeated rows have equal results, and an empty table none.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(lang_out, score_out)
    schema = rest.withColumn(lang_out, F.lit("")).withColumn(score_out, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # it is bounded by the documents that are learned from

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language", shared.value.name), lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(text_col)
            lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            for a, b in slices(lengths, SLICE):
                found = scorer.score(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return rest.mapInArrow(run, schema)
