"""Byte-level BPE encoding and decoding by rank files.

A piece's byte positions are the leaves of a segment tree. A leaf holds the rank of the pair that
starts at its position; an inner node holds the leftmost least rank below it, as one number
rank * 2^32 + position. A merge takes the root, joins the two neighbours and updates at most three
leaves, each in a number of steps logarithmic in the piece's length. Short pieces are merged
together, a row of one numpy tree each; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, task, worker_state

NONE = np.int64(1) << 62
#: Pieces of up to this number of bytes are merged as rows of one tree.
TOGETHER = 64
#: New pieces after which a Python worker forgets those that it has not met since it last forgot.
REMEMBERED = 250_000
#: Characters of text that are encoded at a time.
SLICE = 1_000_000


class ByteBpe:
    """The merges of a rank file: a pair merges if its bytes are a token, least rank first."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known, self.older = {}, {}

    @cached_property
    def single(self) -> np.ndarray:
        """The token of each byte."""
        found = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (found < 0).any():
            raise ValueError("the ranks lack a byte")
        return found

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair of tokens that merges; its key is left * 2^32 + right."""
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        return pairs

    @cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        return np.append(keys[order], NONE), np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(keys))[order], 0)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids; -1 if a pair doesn't merge or a side is missing (-1)."""
        (keys, values), key = self.sorted_pairs, left << 32 | right
        at = np.searchsorted(keys, key)
        return np.where((left >= 0) & (right >= 0) & (keys[at] == key), values[at], -1)

    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(0, n - 1).bit_length()
        none, pairs = int(NONE), self.pairs
        token = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            rank = pairs.get(token[i] << 32 | token[after[i]]) if after[i] < n else None
            return none if rank is None else rank << 32 | i

        for i in range(n):
            tree[size + i] = leaf(i)
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = size + i
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least

        while tree[1] != none:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            token[i] = tree[1] >> 32
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            token[j] = -1
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [t for t in token if t >= 0]

    def merge_short(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Merges of pieces of at most size bytes; size is a power of two."""
        rows, lengths = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, size)
        token = np.where(np.arange(size) < lengths[:, None], self.single[raw], -1)
        after = np.minimum(np.broadcast_to(np.arange(1, size + 1), (rows, size)), lengths[:, None]).copy()
        before = np.broadcast_to(np.arange(-1, size - 1), (rows, size)).copy()
        padded = np.concatenate([token, np.full((rows, 1), -1)], axis=1)
        ranks = self.pair_ranks(padded[:, :-1], padded[:, 1:])
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = np.where(ranks >= 0, ranks << 32 | np.arange(size), NONE)
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        live = np.nonzero(tree[:, 1] != NONE)[0]

        def put(at: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
            x = size + where
            tree[at, x] = value
            while x.size and x[0] > 1:
                x = x >> 1
                tree[at, x] = np.minimum(tree[at, 2 * x], tree[at, 2 * x + 1])

        def refreshed(at: np.ndarray, where: np.ndarray) -> None:
            follow = after[at, where]
            right = np.where(follow < lengths[at], token[at, np.minimum(follow, size - 1)], -1)
            rank = self.pair_ranks(token[at, where], right)
            put(at, where, np.where(rank >= 0, rank << 32 | where, NONE))

        while live.size:
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            j = after[live, i]
            token[live, i] = root >> 32
            token[live, j] = -1
            beyond = after[live, j]
            after[live, i] = beyond
            linked = beyond < lengths[live]
            before[live[linked], beyond[linked]] = i[linked]
            put(live, j, np.full(live.size, NONE))
            refreshed(live, i)
            first = before[live, i]
            held = first >= 0
            refreshed(live[held], first[held])
            live = live[tree[live, 1] != NONE]
        kept = token >= 0
        flat, ends = token[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit numbers."""
        out = [b""] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = array("i", [whole]).tobytes()
            elif len(piece) > TOGETHER:
                out[k] = array("i", self.merge_long(piece)).tobytes()
            elif piece:
                sizes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, ks in sizes.items():
            for start in range(0, len(ks), 8192):
                part = ks[start : start + 8192]
                for k, ids in zip(part, self.merge_short([pieces[k] for k in part], size)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        split = [self.pattern.findall(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        known.update((piece, older[piece]) for piece in new.intersection(older))
        new = list(new.difference(older))
        known.update(zip(new, self.merge([x.encode("utf-8") for x in new])))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > TOGETHER:
                del known[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _loaded(path: str, pattern: str) -> ByteBpe:
    return worker_state(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def _appended(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    """df without a column of that name, and the schema with it."""
    rest = df.drop(name)
    return rest, T.StructType([*rest.schema.fields, T.StructField(name, kind)])


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most that total length, or of one row."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(df: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of whole texts, array<int>, in the column out.

    vocabulary: path of a file of ranks, at the same place on every machine. Each match of
    pattern is encoded by itself; special tokens have no meaning. Null and empty texts have no
    ids. A column that is named like out is replaced; all others stay.
    """
    small_batches(df.sparkSession)
    rest, schema = _appended(df, out, T.ArrayType(T.IntegerType()))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary, pattern)
        for batch in batches:
            lengths = [n or 0 for n in pc.binary_length(batch.column(text_col)).to_pylist()]
            for a, b in slices(lengths, SLICE):
                part = batch.slice(a, b - a)
                ids = bpe.encode([x or "" for x in part.column(text_col).to_pylist()])
                offsets, flat = np.cumsum([0, *map(len, ids)]) // 4, np.frombuffer(b"".join(ids), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, *, vocabulary: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of its ids, binary, in the column out. Null ids give null; an id that
    isn't in the vocabulary is an error. A column that is named like out is replaced."""
    rest, schema = _appended(df, out, T.BinaryType())

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary, pattern)
        for batch in batches:
            lengths = [n or 0 for n in pc.list_value_length(batch.column(ids_col)).to_pylist()]
            for a, b in slices(lengths, SLICE // 4):
                part = batch.slice(a, b - a)
                data = [None if x is None else bpe.decode(x) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, out])

    return rest.mapInArrow(run, schema)
