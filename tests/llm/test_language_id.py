"""Language ID: no alphabet is fixed, and the model is the kernel ridge regression of its docstring."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from photonspark.llm import language_id


def made(draw: random.Random, letters: list[str], n: int = 60) -> str:
    return " ".join("".join(draw.choices(letters, k=draw.randrange(2, 6))) for _ in range(n))


def alphabets() -> dict[str, list[str]]:
    """Five alphabets, and two languages of Han letters that have no letter in common."""
    spans = {"la": (0x61, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "he": (0x5D0, 27), "th": (0xE01, 46), "han1": (0x4E00, 900), "han2": (0x6E00, 900)}
    return {lang: [chr(start + i) for i in range(n)] for lang, (start, n) in spans.items()}


def test_large_alphabets_are_told_apart():
    draw = random.Random(2)
    letters = alphabets()
    model = language_id.fit([(made(draw, letters[lang]), lang) for lang in letters for _ in range(100)])
    texts = [(made(draw, letters[lang]), lang) for lang in letters for _ in range(40)]
    said, score = language_id.predict(model, [t for t, _ in texts])
    assert said == [lang for _, lang in texts] and min(score) > 0.9


def brute_predict(rows, landmarks, texts, ridge=0.1):
    """Margins from sets of n-grams and dense algebra alone."""

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    def kernel(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / math.sqrt(len(a) * len(b))

    languages = sorted({lang for _, lang in rows})
    between = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(between)
    root = (vectors / np.sqrt(values)) @ vectors.T
    train = np.array([[kernel(t, b) for b in landmarks] for t, _ in rows]) @ root
    target = np.array([[1.0 if lang == own else -1.0 for own in languages] for _, lang in rows])
    weight = np.array([1.0 / sum(other == lang for _, other in rows) for _, lang in rows])
    weight *= len(rows) / weight.sum()
    dual = np.linalg.solve(train.T @ (train * weight[:, None]) + ridge * np.eye(len(landmarks)), train.T @ (target * weight[:, None]))
    return np.array([[kernel(t, b) for b in landmarks] for t in texts]) @ root @ dual


def test_margins_match_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_GRAMS", 7)  # several products
    draw, letters = random.Random(4), {"x": list("abcde"), "y": list("defgé"), "z": list("ghia")}
    rows = [(made(draw, letters[lang], 4), lang) for lang, n in (("x", 6), ("y", 4), ("z", 5)) for _ in range(n)]
    model = language_id.fit(rows, n_landmarks=100)  # every row is a landmark
    texts = [made(draw, letters[lang], 3) for lang in "xyzxy"] + ["q", "ab, ab"]
    got = model.margins([language_id.codes_of(t) for t in texts])
    assert np.allclose(got, brute_predict(rows, [t for t, _ in rows], texts), atol=2e-3)


def test_training_rows_are_the_labelled_usable_ones(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(90)] + [(100, "no lang", None), (101, None, "en"), (102, "x" * 30_000, "en"), (None, "null id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_rows(docs, F.col("doc_id") % 2 == 0)
    assert sorted(got) == sorted((t, lang) for i, t, lang in rows[:90] if i % 2 == 0)
    few = language_id.training_rows(docs, F.lit(True), per_language=10)
    assert 0 < len(few) < 50 and set(few) <= {(t, lang) for _, t, lang in rows}


def test_held_out_rows_do_not_matter(spark):
    """Predictions are the same whatever held-out rows say."""
    draw, letters = random.Random(7), alphabets()
    rows = [(i, made(draw, letters["la" if i % 2 else "el"], 20), "la" if i % 2 else "el") for i in range(60)]
    held = lambda i: i % 5 == 0
    lies = [(i, t, ("el" if lang == "la" else "la") if held(i) else lang) for i, t, lang in rows]
    usable = F.col("doc_id") % 5 != 0
    found = []
    for given in (rows, lies):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
        model = language_id.fit(language_id.training_rows(docs, usable))
        found.append(sorted(map(tuple, language_id.identify(docs, model).collect())))
    assert found[0] == found[1] and [r[1] for r in found[0]] == [lang for _, _, lang in rows]


def test_accepted(spark):
    draw, letters = random.Random(9), alphabets()
    model = language_id.fit([(made(draw, letters[lang]), lang) for lang in letters for _ in range(20)])
    rows = [(1, made(draw, letters["ru"])), (2, "12 !"), (3, None), (4, ""), (5, "ꙮꙮ ꚙꚙ ꙮꚙ ꚙꙮ"), (6, made(draw, letters["la"]) + " more" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["accepted"] for r in language_id.identify(docs, model).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    unlearned = language_id.identify(docs, language_id.fit([])).collect()
    assert {r["doc_id"] for r in unlearned if r["accepted"]} == {1, 5, 6} and {r["lang_pred"] for r in unlearned} == {"und"}
