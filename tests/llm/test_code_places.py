"""The hash table of context codes gives the places that a search gives."""

from __future__ import annotations

import numpy as np
import pytest

from photonspark.llm import suffix_tree


@pytest.mark.parametrize("n", [0, 1, 5, 200_000])
def test_places_equal_a_search(n):
    draw = np.random.default_rng(n)
    keys = np.unique(np.r_[draw.integers(0, 1 << 48, n // 2), np.arange(n - n // 2) << 8])
    wanted = draw.permutation(np.repeat(keys, 3))
    assert np.array_equal(suffix_tree.Places(keys).find(wanted), np.searchsorted(keys, wanted))
