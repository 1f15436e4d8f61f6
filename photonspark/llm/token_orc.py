"""Token ids as ORC files in ascending document order.

Documents are range-partitioned and sorted by id, encoded inside the sorted partitions (so the
shuffle carries text, which compresses better than ids) and written as ORC: integer run-length
encoding of the ids, a row index every ``STRIDE`` rows and a Bloom filter on ``doc_id``. Readers
get stripe-parallel splits, and a lookup by id skips files and row groups by min/max and Bloom
filter (``lookup``).

Ids come from the tokenizers library. Where ``by_word`` finds that a tokenizer drops white space and
never merges across it (its normalizer, splitter and model are checked), a block of texts is cut at
ASCII white space and the library encodes each distinct word that a bounded cache does not hold:
the splitter's pieces of words of Latin characters by its model alone, other words as a whole. A
text in which a special token could stand, and every text of another tokenizer, is encoded whole.

Defined results: a null or empty text has the end id alone; null ids come first; repeated ids
are ordered by text; an empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonspark.llm.workspace import Workspace, words_of

END_ID = 1
CACHED = 400_000
STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: The steps of a tokenizer whose ids of a text are those of its words in order.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Every special token starts so.
SPECIAL = "<|"
#: Words of these characters need no composition, and Unicode versions agree on their classes.
LATIN = regex.compile(r"[!-~\u00a1-\u024f]+")
#: The ASCII characters that are no letters, digits, white space or controls.
MARKS = string.punctuation


def by_word(spec: dict) -> bool:
    """Whether a tokenizer's file has the steps that let a text be encoded word by word."""
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITTERS
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        and all(t["content"].startswith(SPECIAL) and not t["normalized"] for t in spec["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class Coder:
    """The tokenizers library, and the ids of words met before as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as held:
            self.by_word = by_word(json.load(held))
        self.model, self.letters = self.library.model, byte_letters()
        self.split = regex.compile(SPLITTERS[0]["pattern"]["Regex"]).findall
        self.raw = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def piece(self, piece: str) -> bytes:
        """One piece of the splitter, by the library's model alone."""
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            self.pieces[piece] = found = b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])
        return found

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.piece(word)
        core = word.rstrip(MARKS)
        if core.isascii() and core.isalpha():  # the marks at the end are one piece
            return self.piece(core) + self.piece(word[len(core) :])
        low = word.lower()
        if len(low) != len(word) or not LATIN.fullmatch(low):
            return self.whole(word)
        return b"".join(map(self.piece, self.split(low)))

    def known(self, words: list[str]) -> list[bytes]:
        if len(self.words) > CACHED:
            self.words.clear()
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        for word in words:
            if word not in self.words:
                self.words[word] = self.word(word)
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.ListArray:
        """Ids of each text, followed by ``end``."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, SPECIAL) if self.by_word else pa.array(np.ones(len(texts), dtype=bool))
        entries = [self.whole(text) for text in texts.filter(special).to_pylist()]
        special = special.to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(special), "", texts)))
        coded = words.flatten().dictionary_encode()
        held = [*self.known(words_of(coded.dictionary)), *entries, end]
        sizes = np.array([len(x) // 4 for x in held])
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), dtype="<u4").astype(np.int32)
        # after the words of a text: its own entry if it was encoded whole, and the end
        more = np.full(len(texts) + len(entries), len(held) - 1)
        closing = np.cumsum(1 + special) - 1
        more[closing[special] - 1] = len(coded.dictionary) + np.arange(len(entries))
        stops = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        order = np.insert(coded.indices.to_numpy(), np.repeat(stops, 1 + special), more)
        n = sizes[order]
        upto = np.cumsum(n)
        values = flat[np.repeat(starts[order] - (upto - n), n) + np.arange(n.sum())]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, upto[stops + closing]].astype(np.int32)), pa.array(values))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per Python worker."""
    return Coder(path)


def encode(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text, without the end id, as little-endian unsigned 32-bit integers."""
    return [np.array(ids, dtype="<u4").tobytes() for ids in coder(path).encode(pa.array(texts, pa.string())).to_pylist()]


def write(docs: DataFrame, target: str, path: str, end_id: int = END_ID) -> None:
    """Encode and write ``docs(doc_id, text)`` to the folder ``target``."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            if batch.num_rows:
                ids = coder(path).encode(batch.column(1), end)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(place, place + len(ids), dtype=np.int64)), ids], names=["doc_id", "place", "ids"])
                place += len(ids)

    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    ordered.mapInArrow(run, f"doc_id {kind}, place long, ids array<int>").write.mode("overwrite").options(**options).orc(target)


def lookup(spark: SparkSession, target: str, ids: list[int]) -> DataFrame:
    """Rows of the named documents; the predicate reaches the ORC reader."""
    return spark.read.orc(target).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])


def index(work: Workspace, target: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, which are read once."""
    files = work.spark.read.orc(target)
    kind = dict(files.dtypes)["doc_id"]
    rows = files.select("doc_id", F.input_file_name().alias("file"), "place", "ids").mapInArrow(_digest, f"doc_id {kind}, file string, place long, n_tokens long, ids_crc32 long")
    rows = work.table(rows, "digests")
    # one row a file: the number of ids before it
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    order = Window.orderBy(F.col("nulls").desc(), "least", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = per_file.select("file", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(before, "file").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents and read the files back."""
    work = Workspace(docs.sparkSession, "token-orc")
    write(docs, work.path("ids"), path)
    return index(work, work.path("ids"))
