"""Near-duplicates: ids that repeat or are null, families in blocks, hot nodes, and measured recall."""

from __future__ import annotations

import random

import numpy as np
import pytest

from photonspark.llm import near_dedup


def edited(draw: random.Random, base: list[str], most: int) -> list[str]:
    copy = list(base)
    for _ in range(draw.randrange(most)):
        copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
    return copy


def brute(rows, size=2, percent=80):
    """Smallest reachable id of every id; an id has all its texts."""
    sets = [(i, near_dedup.exact_shingles(t, size)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if label[i] != label[j] and x and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def check(spark, rows, size=2):
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=size).collect()
    want = brute(rows, size)
    assert len(found) == len(rows)
    for r in found:
        lone = r["doc_id"] is None or not r["n_shingles"]
        assert r["component_id"] == (r["doc_id"] if lone else want[r["doc_id"]]), r
        assert r["kept"] == (lone or r["doc_id"] == r["component_id"])


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    check(spark, [(2, a), (10, a), (10, b), (11, b), (None, a), (None, None), (5, None), (5, c), (7, c), (7, c), (3, "")])


@pytest.mark.parametrize("held", [4_000, 40_000])
def test_families_in_blocks(spark, monkeypatch, held):
    """Both sides of a family cut into many blocks, or one, give the same components; hot nodes are dealt out."""
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "SPREAD", 4)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "MAX_DEPTH", near_dedup.DEPTH)
    draw = random.Random(held)
    bases = [[f"b{k}-{i}" for i in range(80)] for k in range(2)]
    check(spark, [(i, " ".join(edited(draw, bases[i % 2], 9))) for i in range(150)])


def test_hot_nodes_in_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPREAD", 3)
    draw = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    check(spark, [(i, " ".join(edited(draw, base, 8))) for i in range(120)], size=5)


def test_shuffled_texts(spark, monkeypatch):
    """Beyond ``SMALL_ROWS`` pairs the texts are joined by a shuffle."""
    monkeypatch.setattr(near_dedup, "SMALL_ROWS", 0)
    draw = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    check(spark, [(i, " ".join(edited(draw, base, 6))) for i in range(40)])


def test_similar_is_exact():
    draw = random.Random(4)
    for _ in range(3000):
        size, vocabulary = draw.choice([1, 2, 3, 5]), draw.choice([2, 3, 8, 5000])
        left = [b"%d" % draw.randrange(vocabulary) for _ in range(draw.randrange(30))]
        right = list(left) if draw.random() < 0.7 else [b"%d" % draw.randrange(vocabulary) for _ in range(draw.randrange(30))]
        if right and draw.random() < 0.8:
            right[draw.randrange(len(right))] = b"x"
        x, y = (near_dedup.exact_shingles(b" ".join(w).decode(), size) for w in (left, right))
        assert near_dedup.similar(left, right, size, 80) == (bool(x and y) and 100 * len(x & y) >= 80 * len(x | y))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_recall_of_paths_on_true_pairs(percent):
    """Pairs of exactly the similarity, hashed and branched as documents are: nearly all share a leaf and pass the sketch filter."""
    draw, m, n = np.random.default_rng(percent), 200, 1500
    both = round(2 * m * percent / (100 + percent)) + 1
    shares = passes = 0
    trees = near_dedup.trees_for(0.9999, 0.8)
    for _ in range(n // 100):
        values = draw.integers(0, 2**63, (100, 2 * m - both), dtype=np.uint64)
        left, right = (np.array([near_dedup.minhashes(np.unique(v)) for v in part]) for part in (values[:, :m], values[:, m - both :]))
        shares += (near_dedup.paths(left, trees) == near_dedup.paths(right, trees)).any(axis=1).sum()
        apart = ((left ^ right) & 1).sum(axis=1) + (((left ^ right) >> 1) & 1).sum(axis=1)
        passes += (apart <= near_dedup.sketch_limit(0.8)).sum()
    print(f"recall of paths at {percent} %: {shares / n:.4f}, of the sketch filter: {passes / n:.4f}")
    assert shares >= 0.995 * n and passes >= 0.995 * n
