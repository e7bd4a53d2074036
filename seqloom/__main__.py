"""Command line: python -m seqloom COMMAND ... on line files and stored indexes."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kmers, patterns, profiles, suffix
from .plans import index as store
from .plans.scale import Scratch, owned
from .sources.reads import read_lines


#: Rows that are printed; --output takes all.
PRINTED = 1_000


def shown(rows: DataFrame, output: str | None) -> None:
    """Write the rows as tab-separated text below output, or print the first PRINTED."""
    if output:
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(output)
        return
    some = rows.limit(PRINTED + 1).collect()
    for row in some[:PRINTED]:
        print(*row, sep="\t")
    if len(some) > PRINTED:
        print(f"... only the first {PRINTED} rows are printed; --output FOLDER writes all")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index the lines of a file")
    build.add_argument("-k", "--length", type=int, required=True, help="length of the k-mers, 3 at least")
    build.add_argument("-s", "--sample-rate", type=int, help="accepted and without effect: no suffix array is sampled")
    build.add_argument("input")
    build.add_argument("output")
    query = commands.add_parser("query", help="the four queries for the k-mers at some positions")
    query.add_argument("-q", "--nqueries", type=int, required=True)
    query.add_argument("index")
    profile = commands.add_parser("profile", help="in how many reads each k-mer of a read, or of its reverse complement, occurs")
    profile.add_argument("-r", "--reverse", action="store_true")
    profile.add_argument("index")
    profile.add_argument("read", type=int)
    grep = commands.add_parser("grep", help="lines that have a pattern")
    how = grep.add_mutually_exclusive_group()
    how.add_argument("-c", "--count", action="store_true", help="how many lines")
    how.add_argument("-n", "--context", type=int, help="each occurrence with so many symbols on either side")
    grep.add_argument("pattern")
    grep.add_argument("input")
    locate = commands.add_parser("locate", help="where patterns occur: pattern_id, read_id, pos")
    locate.add_argument("-c", "--count", action="store_true", help="how often, and in how many lines")
    locate.add_argument("patterns", help="a file with a pattern on each line")
    locate.add_argument("input")
    display = commands.add_parser("display", help="symbols of a line from a position on")
    display.add_argument("input")
    for name in ("read", "position", "length"):
        display.add_argument(name, type=int)
    for each in (profile, grep, locate):
        each.add_argument("-o", "--output", help="a folder for all rows, as tab-separated text")
    merge = commands.add_parser("merge", help="two indexes as one")
    for name in ("first", "second", "output"):
        merge.add_argument(name)
    extract = commands.add_parser("extract", help="a read of an index")
    extract.add_argument("index")
    extract.add_argument("read", type=int)
    bwt = commands.add_parser("bwt", help="write (sa_idx, read_id, pos, symbol, lcp) of a file's lines")
    bwt.add_argument("input")
    bwt.add_argument("output")
    return parser


def sampled(index: store.Index, n: int) -> DataFrame:
    """The k-mers at n positions, those with the smallest hashes: each run asks the same."""
    rows = index.kmers.orderBy(F.xxhash64("read_id", "pos"), "read_id", "pos").limit(n)
    return rows.select(F.monotonically_increasing_id().alias("query_id"), "kmer")


def query_totals(index: store.Index, n: int) -> DataFrame:
    """One row: n_queries, and the totals of Q1 (rows), Q2, Q3 (rows) and Q4."""
    asked = Scratch(index.reads.sparkSession).keep(sampled(index, n), "asked")
    counts = kmers.count_for(index.stats, asked).agg(F.count(F.lit(1)).alias("n_queries"), F.sum("q2").alias("q2"), F.sum("q4").alias("q4"))
    q1 = kmers.report_reads(index.kmers, asked).agg(F.count(F.lit(1)).alias("q1"))
    q3 = kmers.report_occurrences(index.kmers, asked).agg(F.count(F.lit(1)).alias("q3"))
    return counts.join(F.broadcast(q1)).join(F.broadcast(q3)).select("n_queries", "q1", "q2", "q3", "q4")  # one row each


def main(argv: list[str] | None = None) -> None:
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    began = time.time()
    with owned():
        run(spark, given)
    print(f"{time.time() - began:.1f} seconds")


def run(spark: SparkSession, given: argparse.Namespace) -> None:
    if given.command == "build":
        if given.length < 3:
            raise SystemExit("k must be 3 at least")
        store.save(store.build(read_lines(spark, given.input), given.length, Scratch(spark)), given.output)
    elif given.command == "query":
        query_totals(store.load(spark, given.index), given.nqueries).show()
    elif given.command == "profile":
        index = store.load(spark, given.index)
        read = index.reads.where(F.col("read_id") == given.read)
        found = (profiles.reverse_profile if given.reverse else profiles.profile)(read, index.stats, index.k)
        shown(found.orderBy(F.desc("pos")).select("pos", "kmer", "q2"), given.output)
    elif given.command == "grep":
        reads = read_lines(spark, given.input)
        if given.count:
            patterns.grep_count(reads, given.pattern).show()
        elif given.context is not None:
            shown(patterns.grep_context(reads, given.pattern, given.context).orderBy("read_id", "pos"), given.output)
        else:
            shown(patterns.grep(reads, given.pattern).orderBy("read_id"), given.output)
    elif given.command == "locate":
        asked = read_lines(spark, given.patterns).select(F.col("read_id").alias("pattern_id"), F.col("seq").alias("pattern"))
        found = (patterns.count if given.count else patterns.locate)(read_lines(spark, given.input), asked)
        shown(found.orderBy(*found.columns), given.output)
    elif given.command == "display":
        read = read_lines(spark, given.input).where(F.col("read_id") == given.read)
        read.select(patterns.display_from(F.col("seq"), F.lit(given.position), given.length).alias("text")).show(truncate=False)
    elif given.command == "merge":
        store.save(store.merge(store.load(spark, given.first), store.load(spark, given.second)), given.output)
    elif given.command == "extract":
        store.load(spark, given.index).reads.where(F.col("read_id") == given.read).select("seq").show(truncate=False)
    elif given.command == "bwt":
        reads = read_lines(spark, given.input)
        order = suffix.lcp_doubling(reads, Scratch(spark))
        order.join(suffix.bwt(order, reads), "sa_idx").write.mode("overwrite").parquet(given.output)


if __name__ == "__main__":
    main()
