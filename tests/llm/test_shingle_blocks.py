"""Shingles of a block of texts are those of single texts."""

from __future__ import annotations

import pyarrow as pa
import pytest

from photonspark.llm import near_dedup

ODD = ["", None, " ", "a", " A ", "a b", "  a B\x0b", "x\xa0y z", "\x1c a\x1f b", "İ A a", "a b c d e f a b", "\n\n", "é É 漢 é", "q q q q q q"]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_shingle_sets_equal_those_of_single_texts(size):
    texts, hashes = pa.array(ODD * 3, pa.string()), near_dedup.WordHashes()
    for part in (texts, texts.slice(3), texts.slice(1, 1), texts.slice(5, 7), texts.slice(0, 0)):
        alone = [near_dedup.shingle_set(near_dedup.tokens(t), size, hashes) for t in part.to_pylist()]
        assert [s.tolist() for s in near_dedup.shingle_sets(part, size)] == [s.tolist() for s in alone]
