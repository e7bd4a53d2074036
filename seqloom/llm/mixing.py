"""Mixing sources to target weights.

Sizes are words. Each source's target is found by filling the weights like water up to a cap,
its repetition rate is target / size, and a document is emitted floor(rate) times plus one more
time with a probability of the rate's fraction, decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, doc_key, fresh, word_count

#: Independent draws that a document's hashes give; each source uses the one that comes nearest.
DRAWS = 16
#: Sources up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _draw(key: Column, k: int) -> Column:
    """The k-th uniform number in [0, 1) of a key: eight hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"mix{k // 4}:"), key)), 8 * (k % 4) + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def fill_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(source, source_size) with weight, target and rate.

    Sources are ordered by code point, null last, and weigh weights[0], weights[1], ... over and
    over. share times all sizes is dealt out in proportion; no target exceeds cap times its
    source's size, and the excess goes to the others by weight. Sorted by the level at which each
    source is full, a source's level assumes that those before it are full; the largest level
    that its own source still holds is the solution, so no loop is needed. Sources are few: one
    row each is what meets in a task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    each = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    before, rest, whole = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    each = each.withColumn("level", level)
    each = each.withColumn("water", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole))
    target = F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    each = each.withColumn("target", F.greatest(target, F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return each.select("source", "source_size", "weight", "target", rate.alias("rate"))


def mixing_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): a slim row per document, and a row per source with its rate and draw.

    sized has doc_id, source, size and the key that the draws hash. Of DRAWS draws, plan has for
    each source the one whose total comes nearest to the target (ties: the first); every draw
    takes each document with the rate's fraction as probability.

    Null text: size 0. Null source: a source of its own, last. Null ids draw by their text, so
    equal texts share a fate, as do rows that repeat an id. An empty table gives empty results.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), doc_key(F.col(id_col), text).alias("key"))
    sized = scratch.keep(slim, "sized")
    targets = fill_targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, cap)
    targets = scratch.keep(targets, "targets")
    part = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(_draw(F.col("key"), k) < part, F.col("size")).otherwise(F.lit(0))).alias(f"t{k}") for k in range(DRAWS)]
    met = _with_source(sized, targets.select("source", "rate")).groupBy("source").agg(*taken)
    plan = targets.alias("a").join(met.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", *[f"b.t{k}" for k in range(DRAWS)])
    miss = F.array(*[F.abs(F.floor("rate") * F.col("source_size") + F.col(f"t{k}") - F.col("target")) for k in range(DRAWS)])
    plan = plan.withColumn("draw", F.array_position(miss, F.array_min(miss)).cast("int") - 1).drop(*[f"t{k}" for k in range(DRAWS)])
    return sized, scratch.keep(plan, "plan")


def _with_source(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with its source's columns of plan: a broadcast where the sources' number allows it."""
    plan = plan.withColumnRenamed("source", "_mix_source")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return docs.join(plan, docs["source"].eqNullSafe(plan["_mix_source"]), "left").drop("_mix_source")


def _copies(key: Column) -> Column:
    draw = F.element_at(F.array(*[_draw(key, k) for k in range(DRAWS)]), F.col("draw") + 1)
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized, plan = mixing_plan(docs, **options)
    out = _with_source(sized, plan).withColumn("copies", _copies(F.col("key")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the plan says, its columns unchanged."""
    _, plan = mixing_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    name, both, copy = fresh(docs, "mix_source", "mix_rate", "mix_copy")
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = plan.select(F.col("source").alias(name), F.struct("rate", "draw").alias(both))
    joined = docs.join(F.broadcast(rates) if few else rates, docs[source_col].eqNullSafe(rates[name]), "left")
    rate, draw = F.col(f"{both}.rate"), F.col(f"{both}.draw")
    drawn = F.element_at(F.array(*[_draw(doc_key(docs[id_col], docs[text_col]), k) for k in range(DRAWS)]), draw + 1)
    copies = (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    repeated = joined.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(copy))
    return repeated.drop(copy)
