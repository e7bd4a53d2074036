"""A k-mer index that grows: parts that never change, and versions that list them.

Below a folder, parts/NAME has the tables reads, kmers and stats of some reads, sorted as index.save()
sorts them, with the numbers that these reads have in the whole collection. versions has a row for each
part of each version. A version appears when its one file does, after its parts were written, so a
reader keeps what it has loaded while reads are added or parts compacted; expire() removes what only
old versions list. One writer at a time. appends has an empty file for each append with a name.

When fan parts of a level have come together they become one part of the next level, so a row is written
about as often as the collection has levels: the logarithm to base fan of the number of appends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .index import VERSION, Index, build, write_tables
from .scale import Scratch, exists, numbered, remove, touch

#: Parts of one level that are merged.
FAN = 8

_LISTED = "version long, place int, part string, level int, k int, format int, n_reads long, end long, made_by string"


def listed(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """The parts of a version, the newest if none is given, in order; none before the first append.

    There are fewer than FAN for each level.
    """
    if not exists(spark, f"{path}/versions"):
        return []
    every = spark.read.schema(_LISTED).parquet(f"{path}/versions/*")
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    found = every.where(F.col("version") == version).orderBy("place").collect()
    if not found:
        raise ValueError(f"{path}: no version {version}")
    if found[0]["format"] != VERSION:
        raise ValueError(f"{path}: format {found[0]['format']}, not {VERSION}")
    return found


def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The collection at a version, as one index."""
    parts = listed(spark, path, version)
    if not parts:
        raise ValueError(f"{path}: nothing has been added")
    return _load(spark, path, parts)


def _load(spark: SparkSession, path: str, parts: list[Row]) -> Index:
    read = lambda table: spark.read.parquet(*[f"{path}/parts/{x['part']}/{table}" for x in parts])
    counts = read("stats")
    if len(parts) > 1:  # no read is in two parts, so counts add up
        counts = counts.groupBy("kmer").agg(F.sum("q2").cast("long").alias("q2"), F.sum("q4").cast("long").alias("q4"))
    return Index(read("reads"), read("kmers"), counts, parts[0]["k"])


def _told(path: str, name: str) -> str:
    return f"{path}/appends/{name}"


def _newest(spark: SparkSession, path: str) -> list[dict]:
    """The newest version's parts. The append that it was made by is told, if that wasn't done."""
    parts = [x.asDict() for x in listed(spark, path)]
    if parts and parts[0]["made_by"] is not None:
        touch(spark, _told(path, parts[0]["made_by"]))
    return parts


def _commit(spark: SparkSession, path: str, version: int, parts: list[dict], made_by: str | None = None) -> int:
    rows = [(version, place, x["part"], x["level"], x["k"], VERSION, x["n_reads"], x["end"], made_by) for place, x in enumerate(parts)]
    spark.createDataFrame(rows, _LISTED).coalesce(1).write.mode("error").parquet(f"{path}/versions/{version:012d}")
    return version


def _merged(spark: SparkSession, path: str, parts: list[dict], level: int) -> dict:
    """Neighbouring parts as a new one: kmers and stats meet by ranges of the k-mer."""
    name = f"level-{level}-{uuid.uuid4().hex}"
    write_tables(_load(spark, path, parts), f"{path}/parts/{name}")
    return {**parts[-1], "part": name, "level": level, "n_reads": sum(x["n_reads"] for x in parts)}


def append(spark: SparkSession, path: str, reads: DataFrame, k: int, *, name: str | None = None, fan: int = FAN) -> int:
    """Add reads(read_id, seq), numbered on in the order of their read_id, which is unique; the new version.

    Null reads are empty, a null read_id comes first, and no reads at all are a version of their own.
    name: of the append, as a stream's batch has a number, a file's name can have. One that a version
    was made by isn't repeated.
    """
    before = _newest(spark, path)
    if before and before[0]["k"] != k:
        raise ValueError(f"{path}: k is {before[0]['k']}, not {k}")
    version = before[0]["version"] if before else 0
    if name is not None and exists(spark, _told(path, name)):
        return version
    scratch = Scratch(spark)
    n_reads, end = sum(x["n_reads"] for x in before), before[-1]["end"] if before else 0
    dense = numbered(reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq")), ["read_id"], scratch, "numbered", "_number")
    local = scratch.keep(dense.select(F.col("_number").cast("long").alias("read_id"), "seq"), "reads")
    made = build(local, k, scratch)
    moved = Index(made.reads.withColumns({"read_id": F.col("read_id") + n_reads, "start_pos": F.col("start_pos") + end}), made.kmers.withColumn("read_id", F.col("read_id") + n_reads), made.stats, k)
    part = f"level-0-{uuid.uuid4().hex}"
    write_tables(moved, f"{path}/parts/{part}")
    size = made.describe().first()
    scratch.drop()
    parts = [*before, {"part": part, "level": 0, "k": k, "n_reads": size["n_reads"], "end": end + size["total_length"]}]
    level, made = 0, {part}
    while len(same := [x for x in parts if x["level"] == level]) >= fan:
        parts = [x for x in parts if x["level"] != level] + [_merged(spark, path, same, level + 1)]
        made.add(parts[-1]["part"])
        level += 1
    _commit(spark, path, version + 1, parts, name)
    for gone in made - {x["part"] for x in parts}:  # no version lists what was merged at once
        remove(spark, f"{path}/parts/{gone}")
    return version + 1


def compact(spark: SparkSession, path: str) -> int:
    """All parts as one, in a new version; what is one part already stays."""
    parts = _newest(spark, path)
    if len(parts) < 2:
        return parts[0]["version"] if parts else 0
    one = _merged(spark, path, parts, max(x["level"] for x in parts) + 1)
    return _commit(spark, path, parts[0]["version"] + 1, [one])


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all but the newest versions, and the parts that only those list. Readers of an old
    version must be done. Parts that no version lists, left by appends that failed, stay."""
    if keep < 1:
        raise ValueError("the newest version stays")
    if not exists(spark, f"{path}/versions"):
        return []
    _newest(spark, path)
    every = spark.read.schema(_LISTED).parquet(f"{path}/versions/*").select("version", "part").collect()  # versions that weren't expired
    versions = sorted({x["version"] for x in every})
    old, used = versions[:-keep], {x["part"] for x in every if x["version"] in versions[-keep:]}
    gone = sorted({x["part"] for x in every if x["version"] in old} - used)
    for version in old:
        remove(spark, f"{path}/versions/{version:012d}")
    for part in gone:
        remove(spark, f"{path}/parts/{part}")
    return gone


def appender(path: str, k: int, *, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of reads(read_id, seq): each batch is added once, also if it is repeated."""

    def add(batch: DataFrame, number: int) -> None:
        append(batch.sparkSession, path, batch, k, name=f"batch-{number:012d}", fan=fan)

    return add
