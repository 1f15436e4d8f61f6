"""Quality from compression: zstandard dictionaries of good and of bad text.

A dictionary is trained on each class of a labelled sample. A whole text is cut into blocks of
``BLOCK`` bytes, each block is compressed with either dictionary, and

    x = (bytes with the bad dictionary - bytes with the good one) / bytes of the text

is the normalised difference. Logistic regression on a part of the sample that trained no
dictionary calibrates it to the probability of label 1.

The fit takes at most ``per_class`` labelled documents of each class of at most ``max_bytes``
bytes, the first by a hash of the id. Scoring reads every whole text and nothing else.

Defined results: null and empty texts have x = 0 and get the score of that; labels that are null,
or that disagree for one id, are not learned from; repeated rows are scored alike; an empty table
gives an empty result; without labels of both classes the score is the share of label 1 (0.5
without any). Other input columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import per_row

BLOCK = 512
DICTIONARY_BYTES = 48_000
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * x + self.intercept))))


class Measure:
    """Compressors of one model, built once in a Python worker."""

    def __init__(self, model: CompressionModel):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in map(_dictionary, (model.bad, model.good)) if d is not None]

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or len(self.pair) < 2:
            return 0.0
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return (bad - good) / len(raw)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    if not raw:
        return None
    out = zstandard.ZstdCompressionDict(raw)
    out.precompute_compress(level=LEVEL)
    return out


def train(texts: list[str]) -> bytes:
    """A dictionary of the texts; too few to train on become its raw content."""
    blocks = [raw[at : at + BLOCK] for text in texts if (raw := text.encode("utf-8", "surrogatepass")) for at in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit(rows: list[tuple[str, int]], counts: tuple[int, int]) -> CompressionModel:
    """Fit on (text, label); even rows train the dictionaries, odd rows calibrate.

    ``counts`` are all usable labels of 0 and of 1: the sample is drawn by class, so its odds are
    put back to those of the labels.
    """
    share = (counts[1] + 1) / (sum(counts) + 2)
    flat = CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)))
    by_class = [[t for t, q in rows if q == k] for k in (0, 1)]
    if min(map(len, by_class)) < 4:
        return flat
    bad, good = (train(texts[::2]) for texts in by_class)
    measure = Measure(CompressionModel(good, bad, 0.0, 0.0))
    x = np.array([measure(t) for texts in by_class for t in texts[1::2]])
    y = np.repeat([0.0, 1.0], [len(texts[1::2]) for texts in by_class])
    scale = max(x.std(), 1e-9)
    design, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    odds = math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    return CompressionModel(good, bad, float(w[0] / scale), float(w[1] + odds))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1200, max_bytes: int = 40_000) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """A bounded sample of labelled rows; only their ids travel to the scan of the texts."""
    agreed = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where(F.col("quality") == F.col("most"))
    agreed = agreed.where(F.coalesce(usable, F.lit(False)))
    counts = {r["quality"]: r["count"] for r in agreed.groupBy("quality").count().collect()}
    counts = (counts.get(0, 0), counts.get(1, 0))
    draw = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    chosen = {r["doc_id"]: r["quality"] for q in (0, 1) for r in agreed.where(F.col("quality") == q).orderBy(draw, "doc_id").limit(per_class).collect()}
    if not chosen:
        return [], counts
    rows = docs.where(F.col("doc_id").isin(list(chosen)) & F.octet_length("text").between(1, max_bytes)).select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: ((r["doc_id"] * 2654435761) & 0xFFFFFFFF, r["doc_id"], r["text"]))
    return [(r["text"], int(chosen[r["doc_id"]])) for r in order], counts


def classify(docs: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def block(columns: dict[str, list]) -> dict[str, list]:
        measure = Measure(held.value)
        score = [held.value.probability(measure(t)) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "score": score, "predicted": [int(s >= threshold) for s in score]}

    return per_row(docs, ["doc_id", "text"], f"doc_id {kind}, score double, predicted int", block)
