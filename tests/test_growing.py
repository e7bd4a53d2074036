"""An index that grows by versions, number and bitmap files, and what operators leave behind."""

import os
import random
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import coords, rankselect
from seqloom.plans import index as store
from seqloom.plans import versions
from seqloom.plans.scale import Scratch, owned, shared_folder
from seqloom.sources import numbers

READS = "read_id long, seq string"
TABLES = {"reads": ("read_id", "seq", "start_pos"), "kmers": ("kmer", "read_id", "pos"), "stats": ("kmer", "q2", "q4")}


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def all_of(index):
    return {name: rows(getattr(index, name), *columns) for name, columns in TABLES.items()}


def test_ten_appends_and_a_compaction_equal_one_build(spark, tmp_path):
    draw, path = random.Random(2), str(tmp_path / "grown")
    every = ["".join(draw.choices("ACGT$", k=draw.choice([0, 2, 9, 40]))) for _ in range(40)]
    every[7] = None
    cuts = [0, 5, 9, 9, 10, 20, 24, 30, 31, 36, 40]
    seen = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        turn = spark.createDataFrame([(k * 3 + a, x) for k, x in enumerate(every[a:b])], READS)
        versions.append(spark, path, turn, 3, fan=3)
        seen.append((b, versions.load(spark, path)))
    want = {b: all_of(store.build(spark.createDataFrame(list(enumerate(every[:b])), READS), 3, Scratch(spark))) for b in (24, 40)}
    assert all_of(versions.load(spark, path)) == want[40]
    levels = [x["level"] for x in versions.listed(spark, path)]
    assert levels == sorted(levels, reverse=True) and all(levels.count(x) < 3 for x in levels)
    assert versions.compact(spark, path) == 11 and versions.compact(spark, path) == 11
    assert len(versions.listed(spark, path)) == 1 and all_of(versions.load(spark, path)) == want[40]
    assert all_of(seen[5][1]) == want[24]  # what was loaded before stays
    assert all_of(versions.load(spark, path, 6)) == want[24]
    assert versions.expire(spark, path)
    assert os.listdir(tmp_path / "grown" / "parts") == [versions.listed(spark, path)[0]["part"]]
    assert all_of(versions.load(spark, path)) == want[40]
    with pytest.raises(ValueError, match="no version 6"):
        versions.load(spark, path, 6)
    with pytest.raises(ValueError, match="k is 3"):
        versions.append(spark, path, turn, 4)


def test_a_named_append_is_made_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "grown")
    one, two = (spark.createDataFrame([(0, x)], READS) for x in ("ACGT", "GGGG"))
    versions.append(spark, path, one, 3, name="one")
    assert versions.append(spark, path, one, 3, name="one") == 1
    commit = versions._commit

    def lost(*given):
        raise OSError("lost before its version was there")

    monkeypatch.setattr(versions, "_commit", lost)
    with pytest.raises(OSError):
        versions.append(spark, path, two, 3, name="two")
    monkeypatch.setattr(versions, "_commit", commit)
    versions.append(spark, path, one, 3, name="other")
    versions.append(spark, path, two, 3, name="two")
    versions.compact(spark, path)
    versions.expire(spark, path)
    assert versions.append(spark, path, two, 3, name="two") == 4
    assert rows(versions.load(spark, path).reads, "read_id", "seq") == [(0, "ACGT"), (1, "ACGT"), (2, "GGGG")]


def test_an_index_that_a_stream_adds_to(spark, tmp_path):
    for k, seqs in enumerate((["ACGT", "ACG"], [], ["GACG"])):
        spark.createDataFrame([(10 * k + i, x) for i, x in enumerate(seqs)], READS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    for _ in range(2):  # the second run has nothing new
        reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream = reads.writeStream.foreachBatch(versions.appender(str(tmp_path / "index"), 3)).option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
    found = versions.load(spark, str(tmp_path / "index"))
    assert rows(found.stats, "kmer", "q2", "q4") == [("ACG", 3, 3), ("CGT", 1, 1), ("GAC", 1, 1)]
    assert rows(found.reads, "read_id") == [(0,), (1,), (2,)]


def test_nothing_was_added(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        versions.load(spark, str(tmp_path / "none"))
    assert versions.compact(spark, str(tmp_path / "none")) == 0 and versions.expire(spark, str(tmp_path / "none")) == []
    versions.append(spark, str(tmp_path / "empty"), spark.createDataFrame([], READS), 3)
    assert versions.load(spark, str(tmp_path / "empty")).describe().first()["n_reads"] == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 2048, 5003])
def test_bitmap_files(spark, tmp_path, n):
    draw = random.Random(n)
    bits = [draw.choice([True, False, None]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(bits)), "i long, b boolean").repartition(3)
    numbers.write_bitmap(df, str(tmp_path / "bits"), file_words=50)
    (tmp_path / "bits").mkdir(exist_ok=True)
    assert len(os.listdir(tmp_path / "bits")) - sum(x.startswith(".") for x in os.listdir(tmp_path / "bits")) == -(-n // 1600)
    assert rows(numbers.read_bitmap(spark, str(tmp_path / "bits")), "i", "b") == sorted(((i, bool(b)) for i, b in enumerate(bits)), key=str)


def test_bitmap_format(spark, tmp_path):
    (tmp_path / "a").write_bytes(struct.pack("<3I", 40, 1 | 1 << 31, 2))
    found = rows(numbers.read_bitmap(spark, str(tmp_path / "a")).where("b"), "i")
    assert found == [(0,), (31,), (33,)]
    (tmp_path / "short").write_bytes(struct.pack("<2I", 40, 1))
    with pytest.raises(Exception, match="not a whole bitmap"):
        numbers.read_bitmap(spark, str(tmp_path / "short")).collect()


def test_number_files(spark, tmp_path):
    values = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.int64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(values)], "i long, c long")
    numbers.write_integers(df, str(tmp_path / "n"), file_words=300)
    assert np.concatenate([np.fromfile(tmp_path / "n" / x, "<u4") for x in sorted(x for x in os.listdir(tmp_path / "n") if x[0] != ".")]).tolist() == values.tolist()
    assert rows(numbers.read_integers(spark, str(tmp_path / "n")), "i", "c") == sorted(enumerate(values.tolist()), key=str)


@pytest.mark.parametrize("wrong", ["i <> 5", "i > 49", "i < 10 OR i > 99", "repeat", "null", "wide"])
def test_positions_have_no_gaps(spark, tmp_path, wrong):
    df = spark.range(150).select(F.col("id").alias("i"), F.col("id").alias("c"))
    more = {"repeat": df.limit(1), "null": df.limit(1).select(F.lit(150).alias("i"), F.lit(None).alias("c")), "wide": df.limit(1).select(F.lit(150).alias("i"), F.lit(1 << 32).alias("c"))}
    df = df.unionByName(more[wrong]) if wrong in more else df.where(wrong)
    with pytest.raises(Exception, match="gaps|32 bits"):
        numbers.write_integers(df, str(tmp_path / "n"), file_words=50)
    if wrong in ("null", "wide"):
        return
    with pytest.raises(Exception, match="gaps"):
        numbers.write_bitmap(df.select("i", F.lit(True).alias("b")), str(tmp_path / "b"), file_words=1)


@pytest.mark.parametrize("few", [True, False])
def test_points(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(coords, "BROADCAST_READS", 0)
    reads = spark.createDataFrame([(0, "AC"), (1, None), (2, "")], READS)
    asked = spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 3), (4, None), (5, 1)], "query_id long, read_id long")
    assert rows(coords.get_reads(reads, asked), "query_id", "read_id", "seq") == [(0, 2, ""), (1, 0, "AC"), (2, 0, "AC"), (5, 1, None)]
    seq = spark.createDataFrame([(0, "x"), (1, None)], "i long, c string")
    assert rows(rankselect.access(seq, asked.withColumnRenamed("read_id", "i")), "query_id", "i", "c") == [(1, 0, "x"), (2, 0, "x"), (5, 1, None)]


def test_what_is_owned_goes(spark):
    other, done = {}, threading.Event()

    def elsewhere():
        with owned():
            other["scratch"] = Scratch(spark)
            other["kept"] = other["scratch"].keep(spark.range(3), "x")
            done.wait(60)

    with owned():
        outer = Scratch(spark, "outer")
        outer.keep(spark.range(1), "x")
        thread = threading.Thread(target=elsewhere)
        thread.start()
        with pytest.raises(KeyError), owned():
            inner = Scratch(spark)
            inner.keep(spark.range(2), "x")
            raise KeyError
        at = lambda scratch: os.path.exists(scratch.root.removeprefix("file:"))
        assert at(outer) and not at(inner)
        while "kept" not in other:
            done.wait(0.1)
    assert not at(outer) and at(other["scratch"]) and other["kept"].count() == 3
    done.set()
    thread.join()
    assert not at(other["scratch"])
    assert os.path.isdir(shared_folder(spark).removeprefix("file:"))
