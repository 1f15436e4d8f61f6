"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A block of texts is parted by the tokenizer's pattern. Pieces that the worker has not met yet
become token-position rows (word, position, token) of an in-memory DuckDB. A recursive query
joins neighbouring tokens to the merge table and contracts, in every word, the leftmost pair of
minimum rank, until no pair of a word is in the table. The merge table has a row for every way
to part a vocabulary entry into two entries, so it holds exactly the pairs a rank file allows.
Where a merge cannot give rise to a pair of lower rank (``alone`` is false), all its
non-overlapping occurrences in the word are contracted in one step; one by one, leftmost first,
gives the same tokens. Decoding joins (document, position, token) to the vocabulary and
aggregates the bytes in the order of positions.

The rounds of the recursive query grow with the piece, and each reads all of it. Pieces of over ``HUGE``
bytes (a run of letters without a space, say) are therefore contracted by a heap of pairs, which takes
the same pairs in the same order in n log n steps, so no piece is too long.

A worker caches the pieces met lately, in two generations of ``CACHED`` entries; the memory of a
task thus depends on the block size, not on the partition.

Defined results: a null or empty text has no tokens and decodes to no bytes; invalid surrogates
do not occur in Spark strings; repeated rows are encoded alike; an empty table gives an empty
result. Other input columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from photonspark.llm.workspace import Recent, per_row

CACHED = 80_000

#: A word is one row keyed by its number; a turn unnests it to token-position rows.
ENCODE = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM start
  UNION ALL
  SELECT word, tokens[: pos - 1] || [merged] || tokens[pos + 2 :]
  FROM step JOIN (
    SELECT word, min(merged) AS merged, arg_min(pos, merged::BIGINT * 4294967296 + pos) AS pos
    FROM (
      SELECT word, unnest(tokens[: -2]) AS first, unnest(tokens[2 :]) AS second, unnest(range(1, len(tokens))) AS pos
      FROM step)
    JOIN merges USING (first, second)
    GROUP BY word) USING (word))
SELECT word, tokens FROM step
"""

#: The same for words of over ``LONG`` bytes: where it is safe, all occurrences of the pair at once.
ENCODE_LONG = """
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM start
  UNION ALL
  SELECT word, list(CASE WHEN chosen THEN merged ELSE first END ORDER BY pos) FILTER (NOT swallowed)
  FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS swallowed
    FROM (
      SELECT word, pos, first, merged, merged IS NOT DISTINCT FROM best AND CASE
          WHEN alone THEN pos = min(CASE WHEN merged = best THEN pos END) OVER (PARTITION BY word)
          ELSE (pos - coalesce(max(CASE WHEN merged IS DISTINCT FROM best THEN pos END) OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1
        END AS chosen
      FROM (
        SELECT *, min(merged) OVER (PARTITION BY word) AS best
        FROM (
          SELECT word, unnest(tokens) AS first, unnest(tokens[2 :] || [-1]) AS second, unnest(range(1, len(tokens) + 1)) AS pos
          FROM step)
        LEFT JOIN merges USING (first, second))
      WHERE best IS NOT NULL))
  GROUP BY word)
SELECT word, tokens FROM step
"""
LONG = 48
HUGE = 1024

#: One sort by document and position feeds the aggregate; the connection has one thread, which keeps that order.
DECODE = """
SELECT doc, string_agg(bytes, '') AS bytes
FROM (
  SELECT doc, bytes
  FROM (SELECT doc, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM encoded) JOIN vocabulary USING (token)
  ORDER BY doc::BIGINT * 4294967296 + pos)
GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """A DuckDB connection with the merge and vocabulary tables of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.cache = Recent(CACHED)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB"})
        rows = [(self.ranks[x], self.ranks[y], rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (x := token[:i]) in self.ranks and (y := token[i:]) in self.ranks]
        first, second, merged = map(list, zip(*rows))
        lowest: dict[int, int] = {}
        for x, y, rank in rows:
            for part in (x, y):
                lowest[part] = min(rank, lowest.get(part, rank))
        pairs = pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "merged": pa.array(merged, pa.int32()), "alone": [lowest.get(m, m + 1) < m for m in merged]})
        # bytes as the code points 0-255 of a string, which string_agg can join
        words = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": [token.decode("latin-1") for token in self.ranks]})
        for name, rows in (("merges", pairs), ("vocabulary", words)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte_rank = np.array([self.ranks[bytes((b,))] for b in range(256)], dtype=np.int32)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(first, second): merged for first, second, merged in self.db.sql("SELECT first, second, merged FROM merges").fetchall()}

    def contract(self, raw: bytes) -> bytes:
        """The ids of one piece: a heap gives the leftmost pair of minimum rank of a linked list of tokens."""
        pairs, end = self.pairs, len(raw)
        token = self.byte_rank[np.frombuffer(raw, dtype=np.uint8)].tolist()
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = [(merged, at) for at in range(end - 1) if (merged := pairs.get((token[at], token[at + 1]))) is not None]
        heapify(heap)
        while heap:
            merged, at = heappop(heap)
            right = after[at]
            if token[at] < 0 or right == end or pairs.get((token[at], token[right])) != merged:
                continue  # one of the two has been contracted since
            token[at], token[right] = merged, -1
            after[at] = beyond = after[right]
            if beyond < end:
                before[beyond] = at
                if (found := pairs.get((merged, token[beyond]))) is not None:
                    heappush(heap, (found, at))
            if (left := before[at]) >= 0 and (found := pairs.get((token[left], merged))) is not None:
                heappush(heap, (found, left))
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and cache them as little-endian unsigned 32-bit ids."""
        open_words, raws = [], []
        for piece in pieces:
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                self.cache[piece] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > HUGE:
                self.cache[piece] = self.contract(raw)
            else:
                open_words.append(piece)
                raws.append(raw)
        if not raws:
            return
        sizes = np.array([len(x) for x in raws])
        for query, chosen in ((ENCODE, np.flatnonzero(sizes <= LONG)), (ENCODE_LONG, np.flatnonzero(sizes > LONG))):
            if not len(chosen):
                continue
            offsets = np.r_[0, np.cumsum(sizes[chosen])].astype(np.int32)
            tokens = self.byte_rank[np.frombuffer(b"".join(raws[i] for i in chosen), dtype=np.uint8)]
            self.db.register("start", pa.table({"word": pa.array(chosen.astype(np.int32)), "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))}))
            found = self.db.sql(query).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            lists = found.column("tokens").combine_chunks()
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
            for row, word in enumerate(found.column("word").to_pylist()):
                self.cache[open_words[word]] = ids[at[row] : at[row + 1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parted = [self.find(text) if text else [] for text in texts]
        new: set[str] = set()
        for pieces in parted:
            new.update(pieces)
        self._learn(self.cache.missing(new))
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in parted]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that lists of ids stand for."""
        sizes = [len(x) // 4 for x in ids]
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum(sizes, out=offsets[1:])
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))
        self.db.register("encoded", pa.table({"doc": np.arange(len(ids), dtype=np.int32), "tokens": tokens}))
        out = [b""] * len(ids)
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("encoded")
        for doc, text in zip(got.column("doc").to_pylist(), got.column("bytes").to_pylist()):
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Keys, ``n_tokens``, the digests of the ids and of the decoded bytes; with ``ids`` the ids and the decoded bytes too."""
    kinds = dict(docs.dtypes)

    def block(columns: dict[str, list]) -> dict[str, list]:
        own = codec(path, pattern)
        encoded = own.encode(columns.pop("text"))
        decoded = own.decode(encoded)
        columns |= {
            "n_tokens": [len(x) // 4 for x in encoded],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in encoded],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
        }
        if ids:
            columns |= {"ids": [np.frombuffer(x, dtype="<u4") for x in encoded], "decoded": decoded}
        return columns

    schema = [f"{k} {kinds[k]}" for k in keys] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>", "decoded binary"] * ids
    return per_row(docs, [*keys, "text"], ", ".join(schema), block, rows=768)
