"""The suffix tree keeps rare contexts however large the rest of the corpus is."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonspark.llm import suffix_tree


def brute_tree(texts):
    seen = [Counter() for _ in range(suffix_tree.DEPTH + 1)]
    for text in texts:
        symbols = suffix_tree.END * suffix_tree.DEPTH + b" ".join([*suffix_tree.tokens(text), suffix_tree.END])
        for k, count in enumerate(seen):
            count.update(symbols[i - k : i + 1] for i in range(suffix_tree.DEPTH, len(symbols)))
    levels = [{} for _ in seen]
    for k, count in enumerate(seen):
        for gram, n in count.items():
            levels[k].setdefault(int.from_bytes(gram[:-1], "big"), {})[gram[-1]] = n
        levels[k] = {c: x for c, x in levels[k].items() if k == 0 or sum(x.values()) >= 2}
    return suffix_tree.build_tree(levels)


def test_rare_contexts_stay_as_the_corpus_grows(spark):
    draw = random.Random(5)
    filler = [" ".join(draw.choices(["the", "sun", "rises", "over", "hills"], k=20_000)) for _ in range(20)]
    rare = ["zqxj vwky zqxj"] * 3
    rows = [*enumerate(filler + rare + ["", None, "zqxj over the vwky", "Ünï 日本"])]
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") < 24).collect()
    tree = brute_tree([t for i, t in rows if i < 24])
    assert len(got) == len(rows)
    for r in got:
        symbols, starts = suffix_tree.stream([suffix_tree.tokens(rows[r["doc_id"]][1])])
        assert r["score"] == pytest.approx(float(np.sum(tree.symbol_scores(symbols, suffix_tree.scored(starts)), dtype=float)), rel=1e-4)
