"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of one codeword from each of several codebooks, all of the
full dimension; each codebook is trained on what the ones before it left over. Encoding keeps a
beam of the best partial sums. A query's products with all codewords are a table, so a
candidate's score is a few lookups and its stored norm; the best of each part of the candidates are
then scored exactly on the original vectors. Parts are dealt by a hash of the vector, so the result
doesn't depend on how Spark lays out the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_file, small_batches, write_file

#: Vectors that the codebooks are trained on, about; picked by a hash of the vector.
TRAIN_VECTORS = 16_384
CODEBOOKS, CODEWORDS, BEAM, ROUNDS = 16, 256, 4, 6
#: Queries that are broadcast at a time.
QUERY_BLOCK = 4_096
#: Candidates of a part, about, which are scored at once, and how many of them are scored exactly for each query.
PART, RERANKED = 8_192, 64
#: Queries of a block that are scored at once, and vectors that are encoded at once.
QUERY_STEP, ENCODED = 256, 2_048
#: Tasks of a block of queries, at most; each takes its parts one after another.
TASKS = 16_384


@dataclass
class Codebooks:
    """words: codebooks x codewords x dimension."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) of the vectors, and the norms of the sums that they stand for."""
        n, at = len(x), np.arange(len(x))[:, None]
        rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.uint8)
        for words in self.words:
            width = rest.shape[1]
            gap = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ words.T).reshape(n, width, -1) + (words**2).sum(axis=1)
            flat = gap.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, axis=1), axis=1, kind="stable"), axis=1)
            origin, word = best // len(words), best % len(words)
            rest = rest[at, origin] - words[word]
            codes = np.concatenate([codes[at, origin], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The queries' products with all codewords: codebooks x queries x codewords."""
        return np.matmul(queries[None], self.words.transpose(0, 2, 1))

    @staticmethod
    def scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines, queries x candidates, added up from lookup tables."""
        total = np.zeros((tables.shape[1], len(codes)), dtype=np.float32)
        for k, table in enumerate(tables):
            total += np.take(table, codes[:, k], axis=1)
        return total / np.maximum(norms, 1e-12)


def train(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 7) -> Codebooks:
    """Codebooks of unit vectors, one after another by k-means of what is left over."""
    draw, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(codebooks):
        words = rest[draw.choice(len(rest), codewords, replace=len(rest) < codewords)].copy()
        for _ in range(rounds):
            near = np.argmin((words**2).sum(axis=1) - 2 * rest @ words.T, axis=1)
            sizes = np.bincount(near, minlength=codewords)
            order = np.argsort(near, kind="stable")
            starts = np.cumsum(sizes) - sizes
            used = sizes > 0
            words[used] = np.add.reduceat(rest[order], starts[used], axis=0) / sizes[used, None]
        books.append(words)
        rest = rest - words[np.argmin((words**2).sum(axis=1) - 2 * rest @ words.T, axis=1)]
    return Codebooks(np.stack(books))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Lists of that many numbers as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def usable(vector: Column, dimension: int | None = None) -> Column:
    """No null, no component that is null or not finite, not all zero (and of the dimension)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.size(vector) > 0 if dimension is None else F.size(vector) == dimension
    return F.coalesce(vector.isNotNull() & size & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = 5, train_vectors: int = TRAIN_VECTORS, reranked: int = RERANKED) -> DataFrame:
    """For each query its nearest candidates: query_id, rank, vec_id, score (the cosine).

    Queries are the rows for which is_query is true, candidates all rows with another id. Scores
    are exact, in double precision; ties go to the smaller id. Vectors that are null, zero or hold
    a null or a number that isn't finite take no part, nor do rows with a null id or vectors of
    another than the most frequent length. Rows that repeat an id and vector count once. With
    fewer candidates than nearest, all are given; an empty table gives no rows.

    Equal vectors are one candidate: of those, only the nearest + 1 smallest ids can ever be
    needed. The index covers all of them; its codebooks are trained on about train_vectors. It is
    written once, a file for each part in the shared folder, and each block of QUERY_BLOCK queries,
    which are broadcast in turn, reads it part by part: candidates are shuffled once, whatever the
    number of queries. Each query still meets each candidate's code.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dimension = lengths["n"]
    named = named.where(F.size("v") == dimension)
    same = Window.partitionBy("h", "v").orderBy("id")
    hashed = named.select("id", "v", F.xxhash64("v").alias("h")).distinct()
    first = hashed.withColumn("place", F.row_number().over(same)).where(F.col("place") <= nearest + 1)
    distinct = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = scratch.keep(distinct, "distinct")
    parts = 1 << 30
    n_distinct = distinct.count()
    share = min(parts, int(parts * train_vectors / n_distinct) + 1)
    sample = distinct.where(F.pmod(F.xxhash64("h", F.lit("train")), F.lit(parts)) < share).orderBy("h", "v").limit(2 * train_vectors).select("v").toArrow()
    books = train(unit(matrix(sample.column(0).combine_chunks(), dimension)))
    shared = spark.sparkContext.broadcast(books)  # CODEBOOKS x CODEWORDS x dimension numbers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ENCODED):
                part = batch.slice(start, ENCODED)
                codes, norms = shared.value.encode(unit(matrix(part.column("v"), dimension)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(norms)], names=["part", "ids", "v", "codes", "norm"])

    folder = scratch.path("parts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for batch in _parts(batches):
            part = batch.column(0)[0].as_py()
            last, place = part, place + 1 if part == last else 0
            path, out = f"{folder}/{part:09d}-{place:03d}", pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            write_file(path, out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_pydict({"path": [path]})

    # Parts are whole in one task and in one order; a part of over PART rows is scored in several steps.
    dealt = distinct.select(F.pmod(F.xxhash64("h", F.lit("part")), F.lit(-(-n_distinct // PART))).cast("int").alias("part"), "ids", "v")
    coded = dealt.mapInArrow(encode, "part int, ids array<long>, v array<double>, codes binary, norm float")
    index = scratch.keep(coded.repartition("part").sortWithinPartitions("part", F.element_at("ids", 1), "v").mapInArrow(write, "path string"), "index")
    tasks = min(index.count(), TASKS)
    queries = scratch.keep(named.where("q").select("id", "v").distinct(), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()
        mine = spark.sparkContext.broadcast((rows.column(0).to_numpy(), unit(matrix(rows.column(1).combine_chunks(), dimension)) if len(rows) else np.zeros((0, dimension))))
        found = index.repartition(tasks).mapInArrow(_scorer(shared, mine, dimension, nearest, reranked), "query_id long, vec_id long, score double")
        found.write.mode("append").parquet(scratch.path("found"))
    if not blocks:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.read.parquet(scratch.path("found")).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= nearest)
    return best.select("query_id", "rank", "vec_id", "score")


def _scorer(shared, mine, dimension: int, nearest: int, reranked: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (names, queries) = shared.value, mine.value
        single = queries.astype(np.float32)
        tables = [books.tables(single[a : a + QUERY_STEP]) for a in range(0, len(names), QUERY_STEP)]
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for path in (x for batch in batches for x in batch.column(0).to_pylist()):
            part = pa.ipc.open_stream(read_file(path)).read_next_batch()
            ids, v = part.column(1).to_pylist(), matrix(part.column(2), dimension)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint8).reshape(len(part), -1)
            norms, keep = part.column(4).to_numpy(), min(reranked, len(part))
            for k, table in enumerate(tables):
                a = k * QUERY_STEP
                rough = books.scores(table, codes, norms)
                near = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
                used, where = np.unique(near, return_inverse=True)
                exact = np.einsum("qrd,qd->qr", unit(v[used])[where.reshape(near.shape)], queries[a : a + QUERY_STEP])
                top = np.argsort(-exact, axis=1, kind="stable")[:, : nearest + 1]
                for i in range(len(top)):
                    own = int(names[a + i])
                    met = [(-float(exact[i, j]), x) for j in top[i] for x in ids[near[i, j]] if x != own]
                    best[a + i] = sorted(best[a + i] + met)[:nearest]
        flat = [(int(names[k]), x, -s) for k, found in enumerate(best) for s, x in found]
        yield pa.RecordBatch.from_pydict({"query_id": [x[0] for x in flat], "vec_id": [x[1] for x in flat], "score": [x[2] for x in flat]}, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part, in runs of 2 * PART rows at most; batches are sorted by part."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        if held:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from (one.slice(a, 2 * PART) for a in range(0, len(one), 2 * PART))

    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and b > a and held[-1].column(0)[0] != batch.column(0)[a]:
                yield from whole()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    yield from whole()
