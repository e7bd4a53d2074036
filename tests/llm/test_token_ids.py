"""Ids found word by word are the library's."""

import random
import unicodedata
from array import array

import pytest

from seqloom.llm import token_files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def same(tokenizer, texts):
    found = tokenizer.encode([x.encode() for x in texts])
    wanted = [array("I", x.ids).tobytes() for x in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [x for x, a, b in zip(texts, found, wanted) if a != b]


def test_each_letter_and_mark(tokenizer):
    """Alone and between ASCII letters; of the large blocks of ideographs and syllables every 50th."""
    large = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x17000, 0x18CFF), (0x20000, 0x323AF)]
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM" and (c % 50 == 0 or not any(a <= c <= b for a, b in large))]
    assert tokenizer.by_words and len(codes) > 20_000
    assert not same(tokenizer, [x for c in codes for x in (chr(c), f"a{chr(c)}b", f"A{chr(c)}.")])


def test_mixed_texts(tokenizer):
    pool = [*"abcXYZéÀßñüŸŉſİı'.,;!*$%# \t\n\x0b\x85\xa0́٣Σσς日本한", "<|endoftext|>", "<|startoftext|>", "'s", "'T", "'re", "\x1c"]
    draw = random.Random(1)
    assert not same(tokenizer, ["".join(draw.choice(pool) for _ in range(draw.randrange(30))) for _ in range(10_000)])


def test_forgets_and_long_words(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    texts = [f"word{'s' * (k % 7)} Other{k}." for k in range(20)] + ["ab" * 5000 + " " + "é" * 3000]
    assert not same(tokenizer, texts) and not same(tokenizer, texts[::-1])
    assert all(len(x) <= 100 for x in (*tokenizer, *tokenizer.older))


def test_other_tokenizers_are_not_parted():
    import public_tokenizers

    other = token_files.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words
    assert not same(other, ["The thing, and  a  blank.\n", "", "Ünïcode <|endoftext|> x"])
