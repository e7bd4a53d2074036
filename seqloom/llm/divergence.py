"""How far the sources of a language are from each other and from the language, by their terms.

Each source of a language gives each of the language's kept terms a smoothed share, in exact
integers of a billionth. Two sources differ by the sum of the differences of their shares over all
kept terms. Terms that occur equally often in each source have the same column of counts and give
the same difference: they are grouped by their sparse column, each pair of sources is evaluated
once for each distinct column, and the difference counts as often as there are terms with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column

#: Runs of letters: all but the ASCII characters that aren't letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares are counted in so many parts, and so much is added to each count.
PARTS, ADDED = 1_000_000_000, 5
#: Counts (columns times sources) that a task evaluates at a time, about, and the sources whose pairs it gives.
CELLS, TILE = 4_000_000, 512


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term, and documents that have it.

    Nulls are empty strings. A document's terms and its distinct terms are met in one pass, and
    counted before anything is shuffled, so a frequent term of a large source is a row per task.
    """
    named = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(x) for x, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    found = named.select("lang", "source", F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0)).alias("found"))
    each = found.select("lang", "source", F.size("found").alias("own"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("at", "term"))
    first = F.col("at") >= F.col("own")
    return each.groupBy("lang", "source", "term").agg(F.count_if(~first).alias("n"), F.count_if(first).alias("d"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(PARTS * n / total) of longs, exact at any size."""
    parts = F.lit(PARTS).cast("decimal(18,0)") * n.cast("decimal(20,0)")
    return (F.call_function("div", parts, total.cast("decimal(20,0)")) + 1).cast("long")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays, n at most total: long division by digits of a thousand, so nothing overflows."""
    found, rest = np.zeros(np.broadcast(n, total).shape, dtype=np.int64), n
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return found + 1


def _evaluate(key: tuple, columns: pa.Table, groups: pa.Table, tile: int) -> pa.Table:
    """Pairs of sources (the first of this tile, the second after it) with the sum over some columns."""
    groups = groups.sort_by("source")
    names, terms = groups.column("source").combine_chunks(), groups.column("terms")[0].as_py()
    vector = columns.column("vector").combine_chunks()
    entries = vector.flatten()
    row = np.repeat(np.arange(len(vector)), pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.full((len(vector), len(names)), ADDED, dtype=np.int64)
    counts[row, pc.index_in(entries.field("source"), value_set=names).to_numpy(zero_copy_only=False)] += entries.field("n").to_numpy(zero_copy_only=False)
    times = columns.column("times").to_numpy()
    found = shares(counts, groups.column("total").to_numpy() + ADDED * terms) if terms else counts
    first = np.arange(key[2].as_py() * tile, min((key[2].as_py() + 1) * tile, len(names)))
    values = [times @ np.abs(found[:, s + 1 :] - found[:, s : s + 1]) for s in first]
    many = [len(x) for x in values]
    a, b = np.repeat(first, many), np.concatenate([np.arange(s + 1, len(names)) for s in first]) if len(first) else np.zeros(0, dtype=np.int64)
    value = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part "pair": item is each other source of the language, value the sum over the language's kept
    terms of the difference of both shares. Part "term": item is each kept term that the source has
    and whose share there exceeds that in the whole language, value the excess; only the first top.
    Ranks count from 1 within source and part, larger values first, ties by item in UTF-8 order.

    Null texts, languages and sources are empty strings, which are a language and a source like
    others. Rows that are repeated are documents of their own; ids and other columns play no part.
    A source without terms has its pairs; a language without kept terms has pairs of value 0, and
    one with a single source has none. An empty table gives no rows. Texts of any length are read
    whole.

    A column of counts has an entry for each source at most, as the result has a row for each pair
    of them. Columns are dealt by a hash to blocks whose size falls with the number of sources.
    """
    scratch, tile = Scratch(docs.sparkSession, "divergence"), TILE
    counts = scratch.keep(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "counts")
    vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
    terms = scratch.keep(counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all"), vector).where(F.col("d") >= least_documents).select("lang", "term", "all", "vector"), "terms")
    columns = scratch.keep(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")), "columns")

    named = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(x) for x, c in (("lang", lang_col), ("source", source_col))]).distinct()
    totals = columns.select("lang", "times", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    groups = named.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    kept = columns.groupBy("lang").agg(F.count(F.lit(1)).alias("columns"), F.sum("times").alias("terms"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("whole")).join(kept, "lang", "left").na.fill(0, ["columns", "terms"])
    langs = langs.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("columns") * F.col("sources") / CELLS)), "tiles": F.ceil(F.col("sources") / tile)})
    # Written, so that Spark knows their size: a few languages go to all tasks, and none is one task's.
    langs = scratch.keep(langs, "langs")
    groups = scratch.keep(groups.join(langs, "lang"), "groups")

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = columns.join(langs.select("lang", "blocks", "tiles"), "lang").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks"))).select("lang", "block", every("tiles").alias("tile"), "vector", "times")
    theirs = groups.select("lang", "source", "total", "terms", "tiles", every("blocks").alias("block")).select("lang", "block", every("tiles").alias("tile"), "source", "total", "terms")
    by = ["lang", "block", "tile"]
    pairs = mine.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(lambda key, a, b: _evaluate(key, a, b, tile), "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = scratch.keep(pairs, "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    # A row per source is broadcast by Spark where the written table is small, else joined by a shuffle.
    each = terms.select("lang", "term", "all", F.inline("vector")).join(groups, ["lang", "source"])
    added = F.col("terms") * ADDED
    own, whole = share(F.col("n") + ADDED, F.col("total") + added), share(F.col("all") + ADDED, F.col("whole") + added)
    excess = each.select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value")).where(F.col("value") > 0)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    return ranked(both, "pair").unionByName(ranked(excess, "term").where(F.col("rank") <= top))
