"""What operators leave behind: names, settings, files, identifiers."""

import os

import pytest
from pyspark.sql import functions as F

from seqloom.llm import common, lines, mixing, neighbours, quality, sharding, simhash, warc

TEXTS = ["one two three four\nfive", "one two three four\nfive", "other words here", None]


def documents(spark, **more):
    df = spark.createDataFrame([(i, t, "en", "s0") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    for name in more:
        df = df.withColumn(name, F.lit(more[name]))
    return df


@pytest.mark.parametrize("operator", ["place", "judge", "lines", "simhash", "emit"])
def test_other_columns_stay_whatever_their_names(spark, operator):
    names = ["shard_slot", "SHARD_AT", "shard_name", "_shard_slot", "words", "_words", "hashes", "doc", "ref", "counts", "_lines", "lines", "kept_", "stay", "digest", "once", "_once", "mix_source", "mix_rate", "mix_copy", "_mix_source", "key", "rate", "draw", "size", "fingerprint", "first"]
    run = {"place": lambda df: sharding.place(df, F.col("doc_id").cast("string"), ["a", "b"], slots=11), "judge": quality.judge, "lines": lines.deduplicate, "simhash": simhash.deduplicate, "emit": mixing.emit}[operator]
    found = run(documents(spark, **{x: x for x in names}))
    assert set(names) <= set(found.columns)
    got = found.select(*[F.col(f"`{x}`") for x in names]).distinct().collect()
    assert [tuple(x) for x in got] == [tuple(names)]


def test_batches_only_become_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, after in (("10000", str(common.BATCH_ROWS)), ("100", "100"), ("0", str(common.BATCH_ROWS))):
            spark.conf.set(name, given)
            common.small_batches(spark)
            assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, before)


def test_settings_and_tables_go_with_their_owner(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, there = spark.conf.get(name), set(os.listdir(common.local_path(common.shared_folder(spark))))
    docs = documents(spark)
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    try:
        spark.conf.set(name, "10000")
        with common.owned():
            lines.deduplicate(docs).write.format("noop").mode("overwrite").save()
            simhash.deduplicate(docs).write.format("noop").mode("overwrite").save()
            assert neighbours.search(vectors, F.col("vec_id") % 50 == 0).count() == 10
            assert spark.conf.get(name) == str(common.BATCH_ROWS)
        assert spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, before)
    assert set(os.listdir(common.local_path(common.shared_folder(spark)))) == there


def test_record_ids_are_the_same_in_each_run(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'word ' * (30 + i % 2)}</p>") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    first, again = ({x.key: (x.record_id, x.refers_to_id, x.refers_to) for x in warc.archive_round_trip(spark, pages).collect()} for _ in range(2))
    assert first == again and len({x[0] for x in first.values()}) == 6
