"""Pieces that are too long for the recursive query get the same ids."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from photonspark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def letters(n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return "".join(random.Random(n).choices(alphabet, k=n))


@pytest.mark.parametrize("text", [letters(1100), letters(40_000), letters(5_000, "aeüé"), "a" * 100_000, "ab" * 9_000, "ß漢" * 3_000, "\n" * 5_000, " " * 20_000, "=" * 3_000 + letters(2_000), letters(1_023), letters(1_024)])
def test_long_pieces_equal_the_library(library, text):
    codec = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    ids = codec.encode([text, "a word"])
    assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode(), b"a word"]


def test_heap_and_recursive_query_agree(monkeypatch):
    texts = [letters(random.Random(k).randrange(1, 200), "abcdeinrst") for k in range(300)]
    held = byte_bpe.Codec(PATH, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(byte_bpe, "HUGE", 0)
    assert byte_bpe.Codec(PATH, public_tokenizers.PATTERN).encode(texts) == held


def test_two_generations_of_pieces(library, monkeypatch):
    """Pieces that come back stay, the others go, and ids do not depend on it."""
    monkeypatch.setattr(byte_bpe, "CACHED", 20)
    codec = byte_bpe.Codec(PATH, public_tokenizers.PATTERN)
    for turn in range(30):
        texts = [f"the river and {letters(7 + turn % 3)}{turn}-{k} of it" for k in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(codec.cache) + len(codec.cache.old) < 150
    assert " river" in codec.cache or " river" in codec.cache.old
