"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: the number of distinct character n-grams
(n = 1 to 3, lower-cased, runs of non-letters as one space) that two texts share, divided by
the geometric mean of their own numbers. An n-gram is three code points of 21 bits in one integer,
so no alphabet is fixed. Landmark texts give the Nyström features
``K(x, landmarks) K(landmarks, landmarks)^-1/2``; one ridge regression per language (one versus
the rest) is fitted on them. A batch of texts is scored as (presence matrix) x (landmark presence
matrix), in blocks of the n-grams that occur, then x (dual weights): two matrix products.

The fit takes a bounded sample: at most ``per_language`` labelled documents of each language
(expected number; each document is in by a hash of its id and text) of at most ``max_chars``
characters. Prediction reads every whole text and nothing but the text.

``accepted`` is the verdict of a filter: a text with letters stays if its score is ``ABOVE_CHANCE``
(1 / languages is chance), or if there was no labelled row to learn from.

Defined results: a null text, or one without any letter, gets ``und`` with score 0; rows with a
null ``lang`` are not learned from; repeated rows are predicted alike; an empty table gives an
empty result; with no labelled rows every text gets ``und``. Other input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import per_row

UNDETERMINED = "und"
#: How far from chance to certainty the score of a text must be to be accepted.
ABOVE_CHANCE = 0.08
#: Columns of n-grams in one matrix product.
BLOCK_GRAMS = 8192


@dataclass(frozen=True)
class KernelModel:
    """What prediction needs: sorted codes of the landmarks' n-grams, the landmarks that hold each, and dual weights."""

    languages: list[str]
    grams: np.ndarray
    starts: np.ndarray
    holders: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """K(text, landmark) of texts given by their distinct codes."""
        sizes = np.array([len(codes) for codes in texts])
        out = np.zeros((len(texts), len(self.norms)), dtype=np.float32)
        if not len(self.grams):
            return out
        codes, rows = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        known = self.grams[at] == codes
        at, rows = at[known], rows[known]
        used = np.unique(at)
        at = np.searchsorted(used, at)
        for low in range(0, len(used), BLOCK_GRAMS):
            part = used[low : low + BLOCK_GRAMS]
            mine = (at >= low) & (at < low + BLOCK_GRAMS)
            texts_hold = np.zeros((len(texts), len(part)), dtype=np.float32)
            texts_hold[rows[mine], at[mine] - low] = 1
            n = self.starts[part + 1] - self.starts[part]
            held = np.repeat(self.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            marks_hold = np.zeros((len(part), len(self.norms)), dtype=np.float32)
            marks_hold[np.repeat(np.arange(len(part)), n), self.holders[held]] = 1
            out += texts_hold @ marks_hold
        return out / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32) / self.norms

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def _landmarks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(codes) for codes in texts]
    codes, holders = np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    order = np.argsort(codes, kind="stable")
    grams, starts = np.unique(codes[order], return_index=True)
    return grams, np.r_[starts, len(codes)], holders[order], np.sqrt(np.maximum(sizes, 1)).astype(np.float32)


#: Which code points of the first two planes are letters; those of later planes are.
_LETTER = np.array([chr(c).isalpha() for c in range(0x20000)] + [True])


def codes_of(text: str) -> np.ndarray:
    """Distinct codes of the n-grams of orders 1 to 3, sorted; anything but letters is one 0, and a 0 stands at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    points = np.where(kept, points, 0)
    one = points[np.r_[True, kept[1:] | kept[:-1]]].astype(np.int64) + 1
    two = one[:-1] | one[1:] << 21
    every = np.sort(np.concatenate([one, two, two[:-1] | one[2:] << 42]))
    return every[np.r_[True, every[1:] != every[:-1]]]


def fit(rows: list[tuple[str, str]], n_landmarks: int = 240, ridge: float = 0.1, seed: int = 7) -> KernelModel:
    """Fit on (text, language) rows; landmarks are drawn evenly from the languages."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        none = np.zeros(0, dtype=np.int64)
        return KernelModel([], none, none, none, none.astype(np.float32), np.zeros((0, 0), np.float32))
    texts = [codes_of(text) for text, _ in rows]
    target = np.array([languages.index(lang) for _, lang in rows], dtype=int)

    draw = np.random.default_rng(seed)
    each = max(1, n_landmarks // len(languages))
    chosen = np.concatenate([draw.permutation(np.flatnonzero(target == k))[:each] for k in range(len(languages))])
    model = KernelModel(languages, *_landmarks([texts[i] for i in chosen]), np.zeros((0, 0), np.float32))
    values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in chosen]).astype(np.float64))
    keep = values > 1e-6 * max(1.0, values.max(initial=0))
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([model.kernel(texts[at : at + 128]) for at in range(0, len(texts), 128)]).astype(np.float64) @ whiten
    wanted = np.where(target[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(target, minlength=len(languages))[target]  # every language counts alike
    weight *= len(rows) / weight.sum()
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    dual = whiten @ np.linalg.solve(gram, features.T @ (wanted * weight[:, None]))
    return replace(model, weights=dual.astype(np.float32))


def predict(model: KernelModel, texts: list[str | None], block: int = 128) -> tuple[list[str], list[float]]:
    """Language and score in 0..1 (the softmax of the one-versus-rest margins) of whole texts."""
    said, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    usable = [i for i, text in enumerate(texts) if has_letter(text)] if model.languages else []
    for at in range(0, len(usable), block):
        ids = usable[at : at + block]
        margins = model.margins([codes_of(texts[i]) for i in ids])
        odds = np.exp(4.0 * (margins - margins.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, best, p in zip(ids, margins.argmax(axis=1), odds.max(axis=1)):
            said[i], score[i] = model.languages[best], float(p)
    return said, score


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_rows(docs: DataFrame, usable: Column, per_language: int = 400, max_chars: int = 20_000) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: the counts by language set the rate of a hash of the id."""
    labelled = docs.where(F.coalesce(usable, F.lit(False)) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1_000_000))
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(1_000_000 * min(1.0, per_language / n)))))
    short = F.length("text").between(1, max_chars)
    rows = labelled.where(short & (draw < rate[F.col("lang")])).select("doc_id", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))]


def identify(docs: DataFrame, model: KernelModel, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys (``text`` may be one), ``lang_pred``, ``score`` and ``accepted`` of every row."""
    kinds = dict(docs.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the n-grams of the landmarks

    def block(columns: dict[str, list]) -> dict[str, list]:
        said, score = predict(held.value, columns["text"])
        n = len(held.value.languages)
        accepted = [s >= 1 / n + ABOVE_CHANCE * (1 - 1 / n) if n else has_letter(text) for text, s in zip(columns["text"], score)]
        return columns | {"lang_pred": said, "score": score, "accepted": accepted}

    return per_row(docs, list(dict.fromkeys([*keys, "text"])), ", ".join([f"{k} {kinds[k]}" for k in keys] + ["lang_pred string", "score double", "accepted boolean"]), block, rows=512)
