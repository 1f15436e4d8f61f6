"""The pipeline's stages against brute force on a small corpus, and its registration."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from photonspark.llm import byte_bpe, near_dedup, quality_rules  # noqa: E402


def sentence(draw: random.Random, lang: str, n: int) -> list[str]:
    parts = {"en": ["th", "er", "ing", "on", "an", "wh"], "fr": ["eau", "oi", "que", "tre", "é", "ai"]}[lang]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) + str(draw.randrange(50) if draw.random() < 0.02 else "") for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw, rows, folder = random.Random(6), [], tmp_path_factory.mktemp("sf")
    items = [(i, " ".join(sentence(draw, "en", 30))) for i in range(5)]
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append([i, " ".join(sentence(draw, lang, draw.randrange(60, 150))), lang, f"s{i % 4}", 0])
    for i in range(60, 70):
        copy = rows[i - 60][1].split()
        if i % 2:
            copy[5] = "edited"
        rows.append([i, " ".join(copy), rows[i - 60][2], "copy", 0])
    rows += [[70, None, None, None, None], [71, "", "en", "s", 0], [72, "$$$ ### 12", "en", "s", 0], [73, "too short", "en", "s", 0], [74, "BUY! $$$ " * 40, "en", "s", 0]]
    rows += [[80 + i, rows[20 + i][1] + " " + text, "en", "leak", 0] for i, text in items]
    rows.append(list(rows[30]))
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_match_brute_force(spark, corpus):
    folder, rows, items = corpus
    found = corpus_pipeline.run(spark, folder).collect()

    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    measured = spark.createDataFrame([(r[0], r[1]) for r in kept], "doc_id long, text string")
    good = {r["doc_id"] for r in quality_rules.quality_ledger(measured).where("kept").collect()}
    kept = [r for r in kept if r[0] in good]
    sets = {r[0]: near_dedup.exact_shingles(r[1], 5) for r in kept}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    kept = {r[0]: r for r in kept if label[r[0]] == r[0]}
    grams = [near_dedup.exact_shingles(t, 5) for _, t in items]
    kept = {i: r for i, r in kept.items() if not any(100 * len(g & sets[i]) >= 80 * len(g) for g in grams)}

    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(r[1]) for i, r in kept.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in found} == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
    assert len(found) == len(kept)
    assert set(range(20, 50)) - {30} <= set(kept) | {31} and not any(80 <= i < 85 for i in kept)


def test_stages_return_documents_and_accept_empty_tables(spark, corpus):
    folder, _, _ = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "byte_bpe":
            assert out.columns == corpus_pipeline.COLUMNS


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
