"""What the operators share: scratch tables in the cluster's shared folder, words, column names."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import Scratch, at_end, owned, shared_folder

#: The characters that part words: the space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}

    def one(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    return [one(x) for x in names]


def local_path(uri: str) -> str:
    """A shared folder's path for open(): only file: and plain paths have one."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return uri
    if scheme != "file":
        raise ValueError(f"{scheme}: isn't a mounted file system")
    return "/" + rest.lstrip("/")


def write_file(uri: str, data: bytes) -> None:
    """Write a file of a shared file system whole or not at all.

    The name is the task's, not the attempt's: a repeated attempt replaces equal bytes.
    Mounted file systems are written by rename; others through pyarrow's file systems.
    """
    try:
        path = local_path(uri)
    except ValueError:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def read_file(uri: str) -> bytes:
    """A file that write_file() wrote."""
    try:
        path = local_path(uri)
    except ValueError:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as found:
            return found.read()
    with open(path, "rb") as found:
        return found.read()


def column(name: str, of: str = "") -> Column:
    """The column of that name, whatever characters are in it; with of, the field of that struct."""
    quoted = f"`{name.replace('`', '``')}`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_key(doc_id: Column, text: Column) -> Column:
    """A string that tells documents apart: the id, or a digest of the text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Python workers at most BATCH_ROWS rows at a time, now and for results that are
    computed later; a session's lower setting is left. The end of owned() sets it back.

    The buffers of a batch of texts stand in the JVM and in the worker at once, so their size is
    what bounds an executor's memory. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        at_end(lambda: spark.conf.set(name, before))
        spark.conf.set(name, str(BATCH_ROWS))


_state: dict[Any, Any] = {}


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that the vocabulary or
    memory of one operator doesn't stand beside the next one's."""
    if key not in _state:
        _state.clear()
        give_back()
        _state[key] = make()
    return _state[key]


def give_back() -> None:
    """Return free memory to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back memory when it has met all batches."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run
