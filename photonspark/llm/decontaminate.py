"""Benchmark decontamination: size-partitioned MinHash containment search, on SQL functions only.

Benchmark items are short sets of shingles, documents long ones; an item leaks into a document
when at least ``percent`` of its distinct shingles occur there. Items are partitioned by size
(powers of two). The sketch of an item holds its k smallest shingle hashes, k = 1 + the number of
shingles that the largest item of its partition may miss. A document that contains enough of an
item contains at least one of any k of its shingles, so the search for sketch hashes among all
shingles of the documents finds every leak. Candidates are verified on the shingles themselves.

Defined results: null and empty texts have no shingles and match nothing; a text of fewer words
than a shingle is one shingle of the whole sequence; rows that repeat give one result row per
(doc_id, item_id); null ids are compared as values; an empty table gives an empty result. Other
input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import SPACES, Workspace, ascii_lower

#: Keys or candidates (a few numbers each), and bytes of item shingles, that are broadcast at most.
SMALL_KEYS = 1_000_000
SMALL_BYTES = 64 << 20


def shingles(text: str, words: int, each) -> Column:
    """``each(array of words)`` of every shingle of a text, in order. The lambda binds the words once a row."""
    parts = F.array_remove(F.split(ascii_lower(text), SPACES), "")

    def of(w: Column) -> Column:
        sliding = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: each(F.slice(w, i, words)))
        return F.when(F.size(w) >= words, sliding).when(F.size(w) > 0, F.array(each(w))).otherwise(F.array().cast(sliding_type(each)))

    return F.element_at(F.transform(F.array(parts), of), 1)


def hashed(w: Column) -> Column:
    return F.xxhash64(w)


def joined(w: Column) -> Column:
    return F.concat_ws(" ", w)


def sliding_type(each) -> str:
    return "array<bigint>" if each is hashed else "array<string>"


def sketches(items: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, item_id, item): sketch hashes of the items; ``item`` tells rows of one id apart."""
    sets = items.select("item_id", F.xxhash64("text").alias("item"), F.array_distinct(shingles("text", words, hashed)).alias("h")).where(F.size("h") > 0)
    sized = sets.withColumn("part", F.floor(F.log2(F.size("h"))))
    # one row a size class: at most 31 of them
    largest = sized.groupBy("part").agg(F.max(F.size("h")).alias("largest"))
    missed = F.floor(F.col("largest") * (100 - percent) / 100).cast("int")
    return sized.join(F.broadcast(largest), "part").select("item_id", "item", F.explode(F.slice(F.array_sort("h"), 1, missed + 1)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, version, item_id, n_item and n_shared of every leak; ``version`` (of the text) tells rows of one id apart."""
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    keys = work.table(sketches(items, words, percent), "keys")
    key = F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys  # checked; beyond it both sides are shuffled by hash
    found = docs.select("doc_id", F.xxhash64("text").alias("version"), F.explode(shingles("text", words, hashed)).alias("h"))
    pairs = work.table(found.join(key, "h").select("doc_id", "version", "item_id", "item").distinct(), "candidates")
    few = pairs.count() <= SMALL_KEYS

    sides = pairs.select(F.col("doc_id").alias("c_doc"), F.col("version").alias("c_version"), F.col("item_id").alias("c_item"), "item")
    texts = docs.select("doc_id", "text")
    near = texts.join(F.broadcast(sides) if few else sides, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.xxhash64("text") == F.col("c_version")))
    wanted = pairs.select(F.col("item").alias("w_item")).distinct()
    named = items.select("item_id", F.xxhash64("text").alias("i_item"), "text").join(wanted, F.col("i_item") == F.col("w_item"), "left_semi")
    grams = work.table(named.select("item_id", "i_item", F.array_distinct(shingles("text", words, joined)).alias("i_grams")).distinct(), "grams")
    bytes_held = grams.agg(F.coalesce(F.sum(F.aggregate("i_grams", F.lit(0).cast("long"), lambda n, g: n + F.octet_length(g) + 16)), F.lit(0))).first()[0]
    both = near.join(F.broadcast(grams) if bytes_held <= SMALL_BYTES else grams, F.col("c_item").eqNullSafe(F.col("item_id")) & (F.col("item") == F.col("i_item")))
    shared = F.size(F.array_intersect("i_grams", shingles("text", words, joined)))
    counted = both.select("doc_id", F.col("c_version").alias("version"), "item_id", F.size("i_grams").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    return counted.where(100 * F.col("n_shared") >= percent * F.col("n_item"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every leak."""
    best = leaks(docs, items, words, percent).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))
