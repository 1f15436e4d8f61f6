"""The corpus pipeline: language ID, quality rules, near-dedup, decontamination and BPE over ``documents``.

Defined results: a null or empty text, or one without a letter, goes in the first stage; a null
``lang``, ``source`` or ``n_chars`` changes nothing but what language ID learns from; rows with a
null id are documents of their own, which near-dedup keeps and decontamination judges by their
text; rows of one id are one document, which stays or goes as a whole in near-dedup and of which
the least row stays (so repeated rows are one); of equal texts the smallest id stays; columns other
than those of ``COLUMNS`` are not carried along, whatever their names; empty tables give an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonspark.llm import byte_bpe, decontaminate, language_id, near_dedup, quality_rules
from photonspark.llm.workspace import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Ids (two numbers each) that are broadcast at most.
SMALL_IDS = 2_000_000


def without(docs: DataFrame, dropped: DataFrame, same: Column) -> DataFrame:
    """Rows that match no row of ``dropped``: a broadcast of at most ``SMALL_IDS`` ids, else a shuffled anti-join."""
    ids = Workspace(docs.sparkSession, "dropped").table(dropped, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, same, "left_anti")


def one_per_id(docs: DataFrame) -> DataFrame:
    """Of rows that share an id, the least; only such rows are shuffled, and none where ids are unique."""
    work = Workspace(docs.sparkSession, "repeated")
    twice = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("twice_id")).count().where("count > 1").select("twice_id")
    twice = work.table(twice, "ids")
    n = twice.count()
    if not n:
        return docs
    twice = F.broadcast(twice) if n <= SMALL_IDS else twice
    same = F.col("doc_id") == F.col("twice_id")
    rest = [c for c in COLUMNS if c != "doc_id"]
    least = docs.join(twice, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return docs.join(twice, same, "left_anti").select(*COLUMNS).unionByName(least)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; all with a letter if there is no ``lang`` to learn from."""
    model = language_id.fit(language_id.training_rows(docs, F.lit(True)))
    return language_id.identify(docs, model, keys=tuple(COLUMNS)).where("accepted").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the training policy of the quality rules."""
    return quality_rules.quality_ledger(docs, keys=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    dropped = near_dedup.near_duplicates(docs, words=5).where("NOT kept").select(F.col("doc_id").alias("dropped_id"))
    return one_per_id(without(docs, dropped, F.col("doc_id") == F.col("dropped_id"))).select(*COLUMNS)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    dropped = leaks.select(F.col("doc_id").alias("dropped_id"), F.col("version").alias("dropped_version")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("dropped_id")) & (F.xxhash64("text") == F.col("dropped_version"))
    return without(docs, dropped, same).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality),
    ("near_dedup", deduplicate),
    ("decontamination", remove_benchmarks),
    ("byte_bpe", tokenize),
]

#: SQL expresses neither the language model nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table that the next stage reads."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
