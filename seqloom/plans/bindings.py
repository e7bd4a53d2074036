"""The tables as read collections, bit vectors and symbol sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import to_dna
from ..operators.codes import dense_alphabet
from .scale import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over at least as many partitions as there are tasks at a time: what follows a
    scan here is work on each symbol. A file's splits don't tell, as most of them may hold no row group."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def text_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")))


def dna_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, letters mapped to bases. Written once: filters and branches of a plan would map
    the texts again."""
    return Scratch(spark).keep(text_reads(spark, sf_dir).select("read_id", to_dna(F.col("seq")).alias("seq")), "dna")


def name_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_id"), F.col("p_name").alias("seq")))


def nation_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("read_id"), F.col("n_name").alias("seq"))


def event_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.col("event_type") == "purchase").alias("b"))


def event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types in order, numbered from 1."""
    types = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("event_type").alias("c"))
    return types.join(dense_alphabet(types, Scratch(spark)), "c").select("i", F.col("mapped").alias("c"))


def user_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("c"))
