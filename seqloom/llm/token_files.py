"""Token-id files: Simple-8b words in blocks, an index of blocks and documents before them.

A word is 64 bits: four bits of selector over sixty bits that hold a fixed count of ids of a fixed
width. Selector 0 escapes an id that needs more than sixty bits: the id is the next word. A block
is a run of BLOCK ids that starts at a word of its own, so blocks are decoded independently, each
with a few numpy operations.

A file, all numbers little-endian and 64 bits wide: magic, documents, ids, blocks; then for each
document its id, whether that is null, and the number of ids up to its end; then for each block the
word at which it starts; then the words. Documents stand in ascending order of their id.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import small_batches, task, worker_state, write_file

# Fixed values of the published code: ids a word holds and bits of each, by selector. Here selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

#: Characters of text, or ids, that are worked on at a time.
SLICE = 1_000_000
MAGIC = b"S8BTOK01"
#: Ids of a block.
BLOCK = 65_536
#: Ids after which a writer closes its file. A document is never split.
FILE_IDS = 4_000_000
#: New words after which a Python worker forgets those that it has not met since it last forgot.
REMEMBERED = 500_000
#: The steps and the kind of model with which a text's ids are those of its words.
KNOWN_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]
KNOWN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: Words that are one piece of letters and one of ASCII marks, if any. Normalisation leaves these letters
#: as they are, and the lower case of each is one of them, in any version of Unicode; words of other
#: characters are left to the library.
LETTERS_MARKS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\\[-`{-~]*)")


def needed(ids: np.ndarray) -> np.ndarray:
    """For each id the selector of the least width that holds it; 16 if none does."""
    bits = np.searchsorted(np.array([1 << k for k in range(61)], dtype=np.uint64), np.asarray(ids, dtype=np.uint64), side="right")
    return np.array([*[next(k for k in range(1, 16) if WIDTHS[k] >= w) for w in range(61)], 16], dtype=np.int8)[bits]


NEEDED = needed(np.arange(1 << 16))


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of one block of unsigned ids: each takes the most ids that fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.asarray(ids) if ids.dtype == np.uint32 else np.asarray(ids, dtype=np.uint64)
    # A word takes the ids of a window if none of them needs a wider selector than its own.
    own = NEEDED[ids] if int(ids.max()) < len(NEEDED) else needed(ids)
    chosen, most, width = np.where(own < 16, np.int8(15), np.int8(0)), own, 1
    for selector in range(14, 0, -1):
        count = COUNTS[selector]
        if count > n:
            break
        while width < count:  # most[i] is the most of own[i : i + width]
            more = min(count - width, width)
            most, width = np.maximum(most[: len(most) - more], most[more:]), width + more
        chosen[: len(most)][most <= selector] = selector
    step = np.array(COUNTS)[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    kinds = chosen[starts]
    places = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(kinds == 0)[:-1]))
    words = np.zeros(len(starts) + int((kinds == 0).sum()), dtype=np.uint64)
    for selector in np.unique(kinds).tolist():
        mine = kinds == selector
        if selector == 0:
            words[places[mine] + 1] = ids[starts[mine]]
            continue
        word = np.full(int(mine.sum()), selector << 60, dtype=np.uint64)
        for k in range(COUNTS[selector]):
            word |= ids[starts[mine] + k].astype(np.uint64) << np.uint64(k * WIDTHS[selector]) if WIDTHS[selector] else np.uint64(0)
        words[places[mine]] = word
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of one block's words."""
    words = np.asarray(words, dtype=np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.zeros(len(words), dtype=bool)
    if (kinds == 0).any():
        at = 0
        for k in np.flatnonzero(kinds == 0).tolist():  # the word after an escape may look like one
            if k >= at and not escaped[k]:
                escaped[k + 1], at = True, k + 2
    kept = np.flatnonzero(~escaped)
    kinds = kinds[kept]
    counts = np.array(COUNTS)[kinds]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(kinds).tolist():
        mine = kinds == selector
        first = (ends - counts)[mine]
        if selector == 0:
            out[first] = words[kept[mine] + 1]
        elif WIDTHS[selector]:
            mask = np.uint64((1 << WIDTHS[selector]) - 1)
            for k in range(COUNTS[selector]):
                out[first + k] = words[kept[mine]] >> np.uint64(k * WIDTHS[selector]) & mask
    return out


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file: documents' ids, how many token ids each has, all token ids."""
    blocks = [pack(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    head = np.array([len(doc_ids), len(ids), len(blocks)], dtype="<u8")
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8")
    nulls = np.array([x is None for x in doc_ids], dtype="<u8")
    ends = np.cumsum(np.array(lengths, dtype="<u8"), dtype="<u8")
    offsets = np.cumsum([0, *map(len, blocks)])[: len(blocks)].astype("<u8")
    return MAGIC + b"".join(x.tobytes() for x in (head, keys, nulls, ends, offsets, *[b.astype("<u8") for b in blocks]))


class TokenFile:
    """A file's documents and blocks; blocks are decoded as they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        numbers = np.frombuffer(data, dtype="<u8", offset=8)
        n, self.n_ids, m = map(int, numbers[:3])
        keys, nulls, self.ends, self.offsets = (numbers[3 + a : 3 + b] for a, b in ((0, n), (n, 2 * n), (2 * n, 3 * n), (3 * n, 3 * n + m)))
        self.words = numbers[3 + 3 * n + m :]
        self.doc_ids = [None if null else key for key, null in zip(keys.view("<i8").tolist(), nulls.tolist())]

    def block(self, k: int) -> np.ndarray:
        start = int(self.offsets[k])
        return unpack(self.words[start : int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else len(self.words)])

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.offsets))] or [np.zeros(0, np.uint64)])


class WordTokenizer(dict):
    """The ids that the library gives a whole text, found word by word.

    A tokenizer that drops white space and never joins what it parts (as KNOWN_STEPS and the
    word_bpe files do) gives a text the ids of its words in turn; with any other, the library
    encodes whole texts. As a dict it holds the ids of words, which are bytes, as 32-bit numbers,
    and finds those of a new word when it is asked for them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        with open(path, "rb") as file:
            steps = json.load(file)
        model = {k: steps["model"].get(k) for k in KNOWN_MODEL}
        # No added token may lie in a word of letters and marks, or reach over blanks.
        plain = all(re.search(r"[^A-Za-z\s][A-Za-z]", x["content"]) and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["normalized"]) for x in steps["added_tokens"])
        self.by_words = plain and model == KNOWN_MODEL and [steps["normalizer"], steps["pre_tokenizer"]] == KNOWN_STEPS
        self.model = self.tokenizer.model
        # Bytes stand in the vocabulary as printable characters: themselves, or from U+0100 on in turn.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = dict(zip([b for b in range(256) if b not in shown], range(0x100, 0x200)))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():  # of bytes, this is true of ASCII letters alone
                body, low = word, word.lower()
            elif found := LETTERS_MARKS.fullmatch(word.decode()):
                body, low = found[1].encode(), found[1].lower().encode()
            else:
                body = low = b""
            if not body:
                ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            elif low == word:
                ids = self.letters(low)
            else:  # words that differ in case or in the marks after them share the work
                ids = self[low] + self[word[len(body) :]] if len(body) < len(word) else self[low]
        if len(word) <= 100:
            self[word] = ids
        return ids

    def letters(self, word: bytes) -> bytes:
        """The ids of a word of LETTERS in lower case, which is one piece, merged by the model."""
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text, in UTF-8, its ids as 32-bit numbers."""
        if not self.by_words:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        find = self.__getitem__
        return [b"".join(map(find, x.split())) for x in texts]  # bytes are split at ASCII blanks alone


def _loaded(path: str) -> WordTokenizer:
    return worker_state(("words", path), lambda: WordTokenizer(path))


def write(docs: DataFrame, path: str, *, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the documents' token ids below path and return the manifest, one row per file.

    vocabulary: path of the tokenizer's JSON file, the same on every machine. end_id is added to
    each document. Documents are dealt by ranges of their id (null first, ties by a hash of the
    text) and sorted, so files in the order of part and seq hold them in ascending order. Null and
    empty texts have the end id alone. Other columns aren't read. An empty table writes no file.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    end = b"" if end_id is None else array("I", [end_id]).tobytes()

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = _loaded(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=np.uint32)
            name = f"part-{part:06d}-{seq:06d}.s8b"
            write_file(f"{path}/{name}", to_file(keys, [len(x) // 4 for x in held], ids))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [len(ids)]})

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE):
                for key, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), tokenizer.encode(texts.slice(a, b - a).to_pylist())):
                    keys.append(key)
                    held.append(ids + end)
                    total += len(ids) // 4
                    if total >= file_ids:
                        yield close()
                        keys, held, total, seq = [], [], 0, seq + 1
        if keys:
            yield close()

    return ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long")


def read(spark: SparkSession, path: str, manifest: DataFrame, *, digest: Callable[[memoryview], int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    manifest: a written copy of what write() returned. Ids are 32-bit numbers, as signed ints.
    With a digest, digest replaces ids: its number of their bytes as 32-bit little-endian numbers.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, int)  # the worker may have been a writer's
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                held = TokenFile(data.as_buffer())
                ids, ends = held.ids().astype("<u4"), held.ends.astype(np.int64)
                firsts = np.concatenate(([0], ends[:-1]))
                for a, b in slices((ends - firsts).tolist(), SLICE):
                    offsets = np.append(firsts[a:b], ends[b - 1])
                    if digest:
                        raw = memoryview(ids).cast("B")
                        last = pa.array([digest(raw[4 * x : 4 * y]) for x, y in itertools.pairwise(offsets.tolist())], pa.int64())
                    else:
                        last = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(ids[offsets[0] : offsets[-1]].view(np.int32)))
                    columns = [pa.array([name.as_py()] * (b - a)), pa.array(held.doc_ids[a:b], pa.int64()), pa.array(firsts[a:b]), pa.array((ends - firsts)[a:b]), last]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "in_file", "n_tokens", last_name])

    last_name, kind = ("digest", "long") if digest else ("ids", "array<int>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("file"), "content").mapInArrow(run, f"file string, doc_id long, in_file long, n_tokens long, {last_name} {kind}")
    return found.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", last_name)
