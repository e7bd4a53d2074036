"""Number files and bitmap files, both of unsigned 32-bit little-endian words.

A number file is its numbers. A bitmap file is its number of bits, then the bits, the lowest of a word
first. A folder's files are read in the order of their names, numbered over all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kmers import positions
from ..plans.scale import remove

#: Numbers, or bytes of bits, of a file that are cut out at a time.
CELL = 256
#: Words of a file that is written: 16 MB.
FILE_WORDS = 1 << 22


def _hex(at: Column, n: int) -> Column:
    return F.hex(F.substring("content", at.cast("int") + 1, F.lit(n)))


def _files(spark: SparkSession, path: str, n: Column) -> DataFrame:
    """(content, n, _offset): each file, how many it holds, and how many the files before it do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", n.cast("long").alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))  # a row for each file
    return files.join(F.broadcast(offsets), "path").select("content", "n", "_offset")


def _word(x: Column, k: Column | int) -> Column:
    """The k-th word of hexadecimal digits."""
    place = k * 8 if isinstance(k, Column) else F.lit(k * 8)
    byte = lambda b: F.substring(x, (place + 2 * b + 1).cast("int"), F.lit(2))
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")


def read_integers(spark: SparkSession, path: str) -> DataFrame:
    """(i, c) of number files. What is left of a file after its last whole word is ignored."""
    # Cut into short pieces first: a place in a text is found from its start, in bytes at once.
    cells = _files(spark, path, F.col("length") / 4).select("content", "n", "_offset", F.explode(positions(F.ceil(F.col("n") / CELL))).alias("cell"))
    first = F.col("cell").cast("long") * CELL
    rows = cells.select(_hex(first * 4, 4 * CELL).alias("x"), (F.col("_offset") + first).alias("_offset"), F.explode(positions(F.least(F.lit(CELL), F.col("n") - first))).alias("k"))
    return rows.select((F.col("_offset") + F.col("k")).cast("long").alias("i"), _word(F.col("x"), F.col("k")).alias("c"))


def read_bitmap(spark: SparkSession, path: str) -> DataFrame:
    """(i, b) of bitmap files. A file shorter than its number of bits says is an error."""
    size = F.coalesce(_word(_hex(F.lit(0), 4), 0), F.lit(0))
    whole = F.when((F.col("length") >= 4) & (F.col("length") - 4 >= 4 * F.ceil(size / 32)), size)
    n = F.coalesce(whole, F.raise_error(F.concat(F.lit("not a whole bitmap: "), F.col("path"))).cast("long"))
    cells = _files(spark, path, n).select("content", "n", "_offset", F.explode(positions(F.ceil(F.col("n") / (8 * CELL)))).alias("cell"))
    first = F.col("cell").cast("long") * (8 * CELL)
    left = F.least(F.lit(8 * CELL), F.col("n") - first)
    each = cells.select(_hex(first / 8 + 4, CELL).alias("x"), (F.col("_offset") + first).alias("_offset"), left.alias("n"), F.explode(positions(F.ceil(left / 8))).alias("byte"))
    byte = F.conv(F.substring("x", F.col("byte") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    bits = each.select(byte.alias("x"), (F.col("_offset") + F.col("byte") * 8).alias("_offset"), F.explode(positions(F.least(F.lit(8), F.col("n") - F.col("byte") * 8))).alias("k"))
    return bits.select((F.col("_offset") + F.col("k")).cast("long").alias("i"), (F.expr("shiftright(x, k)").bitwiseAND(1) == 1).alias("b"))


def write_integers(seq: DataFrame, path: str, *, file_words: int = FILE_WORDS) -> None:
    """Number files of seq(i, c), i without gaps from 0. A c that is null or no 32-bit number is an error."""
    _write(seq.select(F.floor(F.col("i") / file_words).alias("file"), (F.col("i") % file_words).alias("at"), F.col("c").cast("long").alias("c")), path, file_words, header=False)


def write_bitmap(bits: DataFrame, path: str, *, file_words: int = FILE_WORDS) -> None:
    """Bitmap files of bits(i, b), i without gaps from 0; a null bit is a zero."""
    mark, word = F.expr("shiftleft(1L, CAST(i % 32 AS INT))"), F.floor(F.col("i") / 32)
    words = bits.select(word.alias("_word"), mark.alias("_mark"), F.when(F.col("b"), mark).otherwise(0).alias("_bit")).groupBy("_word")
    words = words.agg(F.bit_or("_bit").alias("c"), F.bit_or("_mark").alias("_marks"), F.count(F.lit(1)).alias("n"))
    full = F.expr("shiftleft(1L, CAST(n AS INT)) - 1 = _marks")  # the n lowest bits, each once
    placed = words.select(F.floor(F.col("_word") / file_words).alias("file"), (F.col("_word") % file_words).alias("at"), F.when(full, F.col("c")).alias("c"), "n")
    sizes = placed.groupBy("file").agg(F.lit(-1).cast("long").alias("at"), F.sum("n").alias("c"), F.max("at").alias("_last"))  # a row for each file
    sizes = sizes.select("file", "at", F.when(F.ceil(F.col("c") / 32) == F.col("_last") + 1, F.col("c")).alias("c"))
    _write(placed.drop("n").unionByName(sizes), path, file_words, header=True)


def _write(words: DataFrame, path: str, file_words: int, *, header: bool) -> None:
    """Files of words(file, at, c), in the order of at, which has no gaps. A file's name is its number and it
    appears whole, so a task that is repeated replaces what it wrote."""
    remove(words.sparkSession, path)
    first = -1 if header else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        out = name = part = None
        at, ended = first, []

        def end() -> None:
            if out is not None:
                out.close()
                system.move(part, f"{root}/{name:012d}")
                ended.append((name, at))

        for batch in batches:
            if any(x.null_count for x in batch.columns):
                raise ValueError("the positions have gaps or repeat, or a number is null")
            file, place, c = [x.to_numpy() for x in batch.columns]
            if len(c) and not 0 <= c.min() <= c.max() < 1 << 32:
                raise ValueError("a number needs more than 32 bits")
            cuts = [0, *(np.flatnonzero(file[1:] != file[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if name != file[a]:
                    end()
                    name, at, part = int(file[a]), first, f"{root}/.{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(part)
                if (place[a:b] != np.arange(at, at + b - a)).any():
                    raise ValueError("the positions have gaps or repeat")
                at += b - a
                out.write(c[a:b].astype("<u4").tobytes())
        end()
        yield pa.RecordBatch.from_pydict({"file": [x for x, _ in ended], "words": [x for _, x in ended]}, schema=pa.schema([("file", pa.int64()), ("words", pa.int64())]))

    dealt = words.repartition("file").sortWithinPartitions("file", "at")
    found = dealt.mapInArrow(run, "file long, words long").agg(F.count(F.lit(1)).alias("files"), F.max("file").alias("last"), F.count_if(F.col("words") == file_words).alias("full")).first()
    if found["files"] and not (found["files"] == found["last"] + 1 and found["full"] >= found["last"]):
        raise ValueError("the positions have gaps")
