"""The registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from photonspark.llm import byte_bpe, compression_quality, language_id, sql, suffix_tree, token_orc
from photonspark.llm.chat_format import format_chats, from_turns
from photonspark.llm.decontaminate import contained_items
from photonspark.llm.near_dedup import near_duplicates
from photonspark.llm.quality_rules import ablation, ledger, quality_ledger
from photonspark.llm.warc import archive_pages
from photonspark.llm.workspace import Workspace, crc32_of_id, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger(table(spark, sf_dir, "documents"))


def ledger_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; two policies and their ablations read its bits and no text."""
    held = Workspace(spark, "ledger").table(ledger(table(spark, sf_dir, "documents")), "ledger")
    parts = [ablation(held, name, version).select(F.lit(f"{name}@{version}").alias("policy"), "*") for name, version in (("base", 1), ("training", 1))]
    return parts[0].unionByName(parts[1])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))
    model = language_id.fit(language_id.training_rows(docs, ~held_out))
    return language_id.identify(docs, model).withColumn("held_out", held_out)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id() % 7 == 2, F.lit(False))
    return suffix_tree.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The schema of the tool that turns call; longer texts are not valid arguments.
REPLY = {"chars": ("integer", True, {"minimum": 0, "maximum": 300}), "text": ("string", True, {"maxLength": 300})}


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(from_turns(table(spark, sf_dir, "conversations")), REPLY, "reply")


def op9_token_orc(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_orc.encode_to_orc(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))
    model = compression_quality.fit(*compression_quality.training_rows(docs, table(spark, sf_dir, "labels"), ~held_out))
    return compression_quality.classify(docs, model).withColumn("held_out", held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_decontamination": op7_decontamination,
    "op8_tool_calls": op8_tool_calls,
    "op9_token_orc": op9_token_orc,
    "op10_compression_quality": op10_compression_quality,
    "ledger_policies": ledger_policies,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": sql.OP1,
    "op3_near_dedup": sql.OP3,
    "op5_warc": sql.OP5,
    "op7_decontamination": sql.OP7,
    "op8_tool_calls": sql.OP8,
    "ledger_policies": sql.POLICIES,
}
