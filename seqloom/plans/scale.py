"""Numbering and running sums that no single task has to do alone.

A window without a partition key sends all rows to one task. Where the order is a dense integer
position, rows are cut into blocks of it: windows run within blocks, and what a block adds for
those after it is found over one row per block. Where the order is arbitrary, rows are sorted by
ranges once, written, and numbered within their ranges.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import logging
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 65_536


@functools.cache
def _own_folder() -> str:
    """For one local process without spark.checkpoint.dir: a temporary folder that goes with it."""
    found = tempfile.mkdtemp(prefix="seqloom-")
    logging.getLogger("seqloom").warning("spark.checkpoint.dir is unset; intermediate tables go to %s until this process ends", found)
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder that goes with the process serves if driver and executors
    are one local process; anything else is an error, as executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    system, at = _at(spark, path)
    system.delete(at, True)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, if it isn't there."""
    system, at = _at(spark, path)
    if not system.exists(at):
        system.create(at, True).close()


_owner: ContextVar[contextlib.ExitStack | None] = ContextVar("owner", default=None)


@contextlib.contextmanager
def owned() -> Iterator[contextlib.ExitStack]:
    """What operators keep while this lasts is removed at its end, so results are written before.

    Each thread has its own: what another one keeps stays. Within another owned(), the inner one
    removes what was kept in it. Operators may leave other work for the end, as callbacks.
    """
    with contextlib.ExitStack() as stack:
        token = _owner.set(stack)
        try:
            yield stack
        finally:
            _owner.reset(token)


def at_end(f: Callable[[], None]) -> None:
    """Leave f to the innermost owned(), if there is one."""
    stack = _owner.get()
    if stack is not None:
        stack.callback(f)


#: Spark's setting for removing the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables in the folder that driver and executors share: spark.checkpoint.dir.

    A written table cuts the lineage: when an executor is lost, what was written stays. Results read
    them when they are computed; drop(), or the end of owned(), removes them afterwards.
    """

    def __init__(self, spark: SparkSession, name: str = ""):
        self.spark, self.root = spark, f"{shared_folder(spark)}/seqloom-{name and name + '-'}{uuid.uuid4().hex}"
        at_end(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again: its lineage ends here. The write's shuffle files go with its end;
        else they stay until the driver happens to collect its garbage."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        remove(self.spark, self.path(name) if name else self.root)


def scan(df: DataFrame, order: str, keys: Sequence[str] = (), **outs: tuple[str, Column]) -> DataFrame:
    """df with columns that depend on the rows of the same keys before or after this one.

    outs: name = (kind, value). "sum" adds up the values up to and with this row; "last" and
    "first" are the last value that isn't null up to this row, and the first one from this row on;
    "after" is the first one strictly after it. All are found in one pass over the blocks.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumns({f"_v_{x}": value for x, (_, value) in outs.items()})
    by = [*keys, "_block"]
    met = lambda x: F.when(F.col(f"_v_{x}").isNotNull(), F.col(order))
    whole = {"sum": lambda x: F.sum(f"_v_{x}"), "last": lambda x: F.max_by(f"_v_{x}", met(x)), "first": lambda x: F.min_by(f"_v_{x}", met(x))}
    whole["after"] = whole["first"]
    blocks = cut.groupBy(*by).agg(*[whole[kind](x).alias(f"_b_{x}") for x, (kind, _) in outs.items()])
    # Frames that reach the end are built anew for each row, so what comes after is met in descending order.
    until, but = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    before, after = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*but), Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(*but)
    carry = {"sum": lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)), "last": lambda x: F.last(x, ignorenulls=True).over(before), "first": lambda x: F.last(x, ignorenulls=True).over(after)}
    carry["after"] = carry["first"]
    carried = blocks.select(*by, *[carry[kind](f"_b_{x}").alias(f"_c_{x}") for x, (kind, _) in outs.items()])
    up, down = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    within = {"sum": lambda x: F.sum(x).over(up.rowsBetween(*until)), "last": lambda x: F.last(x, ignorenulls=True).over(up.rowsBetween(*until)), "first": lambda x: F.last(x, ignorenulls=True).over(down.rowsBetween(*until)), "after": lambda x: F.last(x, ignorenulls=True).over(down.rowsBetween(*but))}
    inside = cut.withColumns({f"_w_{x}": within[kind](f"_v_{x}") for x, (kind, _) in outs.items()})
    joined = inside.join(carried, by)
    both = {x: F.col(f"_w_{x}") + F.col(f"_c_{x}") if kind == "sum" else F.coalesce(f"_w_{x}", f"_c_{x}") for x, (kind, _) in outs.items()}
    return joined.select(*[F.col(c) for c in df.columns if c not in outs], *[value.alias(x) for x, value in both.items()])


def running_sum(df: DataFrame, value: Column, order: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the sum of value over the rows of the same keys up to and with this one."""
    return scan(df, order, keys, **{out: ("sum", value)})


def numbered(df: DataFrame, order: Sequence[str], scratch: Scratch, name: str, out: str, total: tuple[str, str] | None = None) -> DataFrame:
    """df with the row's number, from 0, in the order of those columns, which must be unique.

    total: (column, out) adds the sum of a column over the rows up to and with this one.
    Rows are dealt by ranges and sorted; the number within a range is taken as they are written,
    so that only a row per range meets in one task.
    """
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", place - F.shiftleft(F.col("_part").cast("long"), 33))
    kept = scratch.keep(dealt, name)
    sums = [F.sum(total[0]).alias("_sum")] if total else []
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried")] if total else []))
    # A row for each range: their number is that of the shuffle's partitions.
    found = kept.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + F.col("_at"))
    if total:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn(total[1], F.sum(total[0]).over(within) + F.col("_carried"))
    return found.drop("_part", "_at", "_offset", "_carried")


#: Keys with over one row in so many are looked up in a broadcast: there are fewer than this.
HOT = 1_000


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """rows with the row of table of their key. table has each key once and, as weight, how many
    rows have it: the keys with over one row in HOT are broadcast, the others dealt by a shuffle,
    so that no task meets more than a thousandth of all rows with one key."""
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot, keys = F.col(weight) * HOT > total, list(keys)
    most = F.broadcast(table.where(hot).drop(weight))
    return rows.join(most, keys).unionByName(rows.join(F.broadcast(most.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(weight), keys))
