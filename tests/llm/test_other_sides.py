"""Plans beyond a size bound give the same rows, and models are those that plain Python computes."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from photonspark.llm import compression_quality, decontaminate, suffix_tree, warc


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


# -- plans beyond a bound --------------------------------------------------------------------------


def test_contained_items_without_broadcasts(spark, monkeypatch):
    draw = random.Random(2)
    items = [(i, sentence(draw, draw.randrange(3, 40))) for i in range(12)] + [(None, sentence(draw, 9)), (3, sentence(draw, 12))]
    rows = [(i, f"{sentence(draw, 30)} {items[i % 14][1]} {sentence(draw, 20)}") for i in range(40)] + [(None, items[0][1]), (None, "clean words only"), (7, items[5][1]), (8, None)]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted(map(repr, decontaminate.contained_items(docs, tests).collect()))
    held = run()
    monkeypatch.setattr(decontaminate, "SMALL_KEYS", 0)
    monkeypatch.setattr(decontaminate, "SMALL_BYTES", 0)
    assert run() == held and len(held) > 30


def test_archive_without_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (1000 + i % 3)) for i in range(20)], "page_id long, url string, html string")
    run = lambda: sorted(map(tuple, warc.archive_pages(pages).collect()))
    held = run()
    monkeypatch.setattr(warc, "SMALL_GROUPS", 0)
    assert run() == held and [r[3] for r in held] == ["revisit"] * 17 + ["response"] * 3


# -- suffix tree -----------------------------------------------------------------------------------


def brute_scores(train: list[str], texts: list[str]) -> list[float]:
    depth = suffix_tree.DEPTH
    after = [defaultdict(Counter) for _ in range(depth + 1)]

    def steps(text):
        symbols = "\n" * depth + " ".join([*text.lower().split(), "\n"])
        raw = symbols.encode()
        return ((raw[:i], raw[i]) for i in range(depth, len(raw)))

    for text in train:
        for history, symbol in steps(text):
            for k in range(depth + 1):
                after[k][history[len(history) - k :]][symbol] += 1
    states = {b""}
    for k in range(depth, 0, -1):
        for context, counts in after[k].items():
            n, suffix = sum(counts.values()), after[k - 1][context[1:]]
            m = sum(suffix.values())
            gain = sum(c / n * math.log(c / n / (suffix[s] / m)) for s, c in counts.items())
            if n >= suffix_tree.LEAST and gain >= suffix_tree.DIVERGENCE and 2 * n * gain >= len(counts) * math.log(max(n, 2)):
                states |= {context[j:] for j in range(len(context) + 1)}
    total = sum(after[0][b""].values())

    def probability(context, symbol):
        if not context:
            return (after[0][b""][symbol] + 1) / (total + 256)
        counts = after[len(context)][context]
        return (counts[symbol] + len(counts) * probability(context[1:], symbol)) / (sum(counts.values()) + len(counts))

    def longest(history):
        return next(c for k in range(depth, -1, -1) if (c := history[len(history) - k :]) in states)

    return [sum(math.log10(probability(longest(history), symbol)) for history, symbol in steps(text)) for text in texts]


def test_suffix_tree_matches_brute_force(spark):
    draw = random.Random(3)
    make = lambda: " ".join("".join(draw.choices("abcé", [5, 3, 2, 1], k=draw.randrange(1, 6))) for _ in range(draw.randrange(0, 60)))
    rows = [(i, make()) for i in range(40)] + [(40, ""), (41, "zz zz"), (42, "ABC abc")]
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 4 != 1).collect()
    want = brute_scores([t for i, t in rows if i % 4 != 1], [t for _, t in rows])
    assert [r["score"] for r in sorted(got)] == pytest.approx(want, rel=1e-4)


# -- compression classifier ------------------------------------------------------------------------


def test_compression_scores_match_brute_force(spark):
    draw = random.Random(5)
    rows = [(" ".join(draw.choices(["river", "stone", "garden"] if q else ["BUY!!", "$$$", "river"], k=draw.randrange(1, 200))), q) for q in draw.choices([0, 1], [1, 2], k=300)]
    counts = (sum(q == 0 for _, q in rows), sum(q == 1 for _, q in rows))
    model = compression_quality.fit(rows, counts)

    def difference(text):
        raw, sizes = text.encode(), []
        for held in (model.bad, model.good):
            squeeze = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(squeeze.compress(raw[i : i + compression_quality.BLOCK])) for i in range(0, len(raw), compression_quality.BLOCK)))
        return (sizes[0] - sizes[1]) / len(raw) if raw else 0.0

    # the calibration is the optimum of the penalised likelihood of the rows that trained no dictionary
    tuned = [(difference(t), q) for k in (0, 1) for t, q in [r for r in rows if r[1] == k][1::2]]
    x, y = np.array(tuned).T
    share = (counts[1] + 1) / (sum(counts) + 2)
    odds = math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    slope, shift, scale = model.slope, model.intercept - odds, x.std()
    loss = lambda w, b: -sum(q * z - np.logaddexp(0, z) for z, q in zip(w * x / scale + b, y)) + 0.005 * (w * w + b * b)
    best = loss(slope * scale, shift)
    assert all(loss(slope * scale + d, shift + e) >= best - 1e-9 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))

    texts = [t for t, _ in rows[:40]] + ["", None, "ü" * 300, "river stone " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in compression_quality.classify(docs, model).collect():
        want = 1 / (1 + math.exp(-(model.slope * difference(texts[r["doc_id"]] or "") + model.intercept)))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.7)
