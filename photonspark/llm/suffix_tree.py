"""Language-model scoring with a probabilistic suffix tree.

A text is the sequence of its words (A-Z lowered) and one end. The tree models the symbols of
that sequence: the bytes of each word, a space after each word, and a line feed as the end.
Contexts are the last 0 to ``DEPTH`` symbols; before a text stand line feeds. Symbol counts
after every context of full depth are gathered from the whole training corpus (sorted counts of
each block of documents, then one aggregation); those of shorter contexts are sums of them.

A context enters the tree if it occurs at least ``LEAST`` times, whatever the size of the corpus,
and if the Kullback-Leibler divergence of its next-symbol distribution from that of its longest
proper suffix passes a test, or if a longer context that passes ends with it. Distributions are
smoothed towards the suffix's (Witten-Bell), down to the empty context, where each of the 256
bytes has one extra count; so every text has a probability above 0. A symbol is scored in the
longest suffix of its history that is a state of the tree.

The tree is never in one place. Contexts that share their last ``NEAR + 1`` symbols form a subtree
of at most 256 ** (DEPTH - NEAR - 1) of the longest contexts, and tasks work on whole subtrees.
Only contexts of up to ``NEAR`` symbols (256 ** NEAR at most, whatever the corpus) are broadcast.
Each distinct pair of context and symbol of a block is sent to its subtree, looked up there, and
sent back with its probability to the documents of the block.

The base score needs exact corpus counts of words. Words of relative frequency ``COMMON`` or
more (at most ``1 / COMMON`` of them) are looked up in a broadcast table; all others are joined
by word, without any cap.

Defined results: null and empty texts are the end alone; null ids are kept (and are held out
only if the caller's condition says so); repeated rows are scored and counted each; an empty
table gives an empty result; without training rows N and V are 0 and the tree is the uniform
empty context. Other input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import Workspace

DEPTH = 5
LEAST = 2
NEAR = 2
COMMON = 5e-7
DIVERGENCE = 0.001
END = b"\n"
HELD_ROWS = 3_000_000
BLOCK_BYTES = 16 << 20
CHUNK_ROWS = 200_000
SUBTREE = 8 * (DEPTH - NEAR)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of symbols, each after ``DEPTH`` line feeds, and where each starts."""
    pad = END * DEPTH
    blocks = [pad + b" ".join([*words, END]) for words in parts]
    starts = np.r_[0, np.cumsum([len(b) for b in blocks])]
    return np.frombuffer(b"".join(blocks), dtype=np.uint8), starts


def scored(starts: np.ndarray) -> np.ndarray:
    """Positions of ``stream`` that are symbols of a text and not padding."""
    keep = np.ones(starts[-1], dtype=bool)
    for k in range(DEPTH):
        keep[starts[:-1] + k] = False
    return np.flatnonzero(keep)


def context_codes(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before a symbol, the latest highest, and the symbol lowest, as one integer."""
    wide = symbols.astype(np.int64)
    code = wide.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= wide[:-k] << (8 * (DEPTH + 1 - k))
    return code[at]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _number_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in _blocks(batches):
        if held and held + batch.nbytes > BLOCK_BYTES:
            block, held = block + 1, 0
        held += batch.nbytes
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), *batch.columns], names=["block", *batch.schema.names])


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct codes of the texts of each block, and how often they occur in its training texts."""
    block, keys, counts = 0, [], []

    def flush() -> pa.RecordBatch:
        key, n = merged(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(n)], names=["block", "code", "n"])

    for batch in _blocks(batches):
        owner, trained = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        for own in np.unique(owner):
            if own != block and keys:
                yield flush()
                keys, counts = [], []
            block = own
            for learns in (True, False):
                rows = np.flatnonzero((owner == own) & (trained == learns))
                if not len(rows):
                    continue
                symbols, starts = stream([tokens(t) for t in batch.column(2).take(pa.array(rows)).to_pylist()])
                key, n = np.unique(context_codes(symbols, scored(starts)), return_counts=True)
                keys.append(key)
                counts.append(n if learns else np.zeros(len(key), dtype=np.int64))
            if sum(map(len, keys)) > 2 * len(keys[0]) + CHUNK_ROWS:
                key, n = merged(keys, counts)
                keys, counts = [key], [n]
    if keys:
        yield flush()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in _blocks(batches):
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            held[END] += 1
        if len(held) > HELD_ROWS // 4:
            yield flush()
    if held:
        yield flush()


@dataclass(frozen=True)
class SuffixTree:
    """A tree in memory, for counts that are at hand. ``child[state, symbol]`` is the state whose context has that symbol in front; 0 is none (or the root)."""

    classes: np.ndarray
    child: np.ndarray
    log_p: np.ndarray

    def symbol_scores(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols at the given positions."""
        width = self.child.shape[1]
        ids = self.classes[symbols]
        state = np.zeros(len(at), dtype=np.int32)
        live = np.arange(len(at))
        child = self.child.ravel()
        for k in range(1, DEPTH + 1):
            found = child[state[live] * width + ids[at[live] - k]]
            live, found = live[found > 0], found[found > 0]
            if not len(live):
                break
            state[live] = found
        return self.log_p.ravel()[state * width + ids[at]]


def build_tree(levels: list[dict[int, dict[int, int]]]) -> SuffixTree:
    """``levels[k]``: context of k symbols (as an integer) -> next symbol -> count."""
    root = levels[0].get(0, {})
    seen = sorted(root)
    classes = np.full(256, len(seen), dtype=np.int32)
    classes[seen] = np.arange(len(seen))
    width, total = len(seen) + 1, sum(root.values())
    top = np.full(width, 1.0 / (total + 256))
    for symbol, n in root.items():
        top[classes[symbol]] = (n + 1) / (total + 256)

    def smoothed(counts: dict[int, int], parent: np.ndarray) -> np.ndarray:
        p = parent * len(counts)
        for symbol, n in counts.items():
            p[classes[symbol]] += n
        return p / (sum(counts.values()) + len(counts))

    # divergence tests from the longest contexts up; a suffix of a kept context is kept
    keep: list[set[int]] = [set() for _ in levels]
    for k in range(len(levels) - 1, 0, -1):
        for context, counts in levels[k].items():
            suffix = levels[k - 1].get(context & (256 ** (k - 1) - 1))
            if suffix is None:
                continue
            n, m = sum(counts.values()), sum(suffix.values())
            gain = sum(c / n * math.log((c / n) / (suffix[s] / m)) for s, c in counts.items())
            if context in keep[k] or (gain >= DIVERGENCE and 2 * n * gain >= len(counts) * math.log(max(n, 2))):
                keep[k].add(context)
                if k > 1:
                    keep[k - 1].add(context & (256 ** (k - 1) - 1))
    number: list[dict[int, int]] = [{0: 0}]
    rows, edges, state = [top], [], 1
    for k in range(1, len(levels)):
        number.append({})
        for context in sorted(keep[k]):
            parent = number[k - 1].get(context & (256 ** (k - 1) - 1))
            if parent is None:
                continue
            number[k][context] = state
            edges.append((parent, classes[context >> (8 * (k - 1))], state))
            rows.append(smoothed(levels[k][context], rows[parent]))
            state += 1
    child = np.zeros((state, width), dtype=np.int32)
    for parent, symbol, to in edges:
        child[parent, symbol] = to
    return SuffixTree(classes, child, np.log10(np.array(rows)).astype(np.float32))


class Level:
    """Symbol counts after contexts of ``k`` symbols, and which of these contexts are states."""

    def __init__(self, code: np.ndarray, n: np.ndarray, k: int):
        self.k = k
        self.keys, where = np.unique(self.key(code), return_inverse=True)
        self.counts = np.bincount(where, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.contexts, self.starts = np.unique(self.keys >> 8, return_index=True)
        self.n = np.add.reduceat(self.counts, self.starts) if len(self.keys) else self.counts
        self.kinds = np.diff(self.starts, append=len(self.keys))
        self.keep = np.full(len(self.contexts), k == 0)

    def key(self, code: np.ndarray) -> np.ndarray:
        return code >> (8 * (DEPTH + 1 - self.k)) << 8 | code & 255

    def test(self, parent: Level, longer: np.ndarray) -> None:
        """Keep contexts that diverge from their suffix in ``parent``, and the suffixes in ``longer``."""
        if len(self.keys):
            of, suffix = np.repeat(np.arange(len(self.n)), self.kinds), self.keys >> 16
            share = self.counts / self.n[of]
            other = parent.counts[np.searchsorted(parent.keys, suffix << 8 | self.keys & 255)] / parent.n[np.searchsorted(parent.contexts, suffix)]
            gain = np.add.reduceat(share * np.log(share / other), self.starts)
            self.keep = (self.n >= LEAST) & (gain >= DIVERGENCE) & (2 * self.n * gain >= self.kinds * np.log(np.maximum(self.n, 2)))
            self.keep |= np.isin(self.contexts, longer)

    def suffixes(self) -> np.ndarray:
        return np.unique(self.contexts[self.keep] >> 8)


def lookup(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it has none."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), dtype=values.dtype)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, values[at], 0)


class Places:
    """Where keys stand in a sorted array of distinct keys: by a hash table, and by a search for the few that lost their slot to another."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - (4 * len(keys) + 1).bit_length())
        self.slots = np.zeros(1 << 64 - int(self.shift), dtype=np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64)
        mixed ^= mixed >> np.uint64(23)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed >>= self.shift
        return mixed.view(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The places of keys that are all in the array."""
        at = self.slots[self.slot(wanted)]
        lost = np.flatnonzero(self.keys[at] != wanted)
        at[lost] = np.searchsorted(self.keys, wanted[lost])
        return at


def log_probabilities(levels: list[Level], code: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each code in the longest suffix of its context that is a state."""
    root = levels[0]
    p = (lookup(root.keys, root.counts, root.key(code)) + 1) / (root.counts.sum() + 256)
    live = np.ones(len(code), dtype=bool)
    for level in levels[1:]:
        key = level.key(code)
        live &= lookup(level.contexts, level.keep, key >> 8).astype(bool)
        kinds = lookup(level.contexts, level.kinds, key >> 8)
        total = np.maximum(lookup(level.contexts, level.n, key >> 8) + kinds, 1)
        p = np.where(live, (lookup(level.keys, level.counts, key) + kinds * p) / total, p)
    return np.log10(p)


def tested(levels: list[Level], longer: np.ndarray, least: int) -> np.ndarray:
    """Divergence tests from the longest contexts up to those of ``least`` symbols; returns the suffixes these need."""
    for k in range(len(levels) - 1, least - 1, -1):
        levels[k].test(levels[k - 1], longer)
        longer = levels[k].suffixes()
    return longer


NONE = np.empty(0, dtype=np.int64)


def subtrees(near: list[Level], code: np.ndarray, n: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """All levels for the whole subtrees of the given codes, and the contexts of ``NEAR`` symbols they need."""
    levels = [*near, *(Level(code[n > 0], n[n > 0], k) for k in range(NEAR + 1, DEPTH + 1))]
    return levels, tested(levels, NONE, NEAR + 1)


def _whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK_ROWS`` rows or one subtree of rows that are sorted by code."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("code").to_numpy()
        if sum(b.num_rows for b in held) + batch.num_rows >= CHUNK_ROWS:
            cut = int(np.searchsorted(code, code[-1] >> SUBTREE << SUBTREE))
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            elif held and held[-1].column("code")[-1].as_py() >> SUBTREE != code[0] >> SUBTREE:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def by_subtree(codes: DataFrame) -> DataFrame:
    return codes.repartition(F.shiftright("code", SUBTREE)).sortWithinPartitions("code")


def fit_near(work: Workspace, codes: DataFrame) -> list[Level]:
    """The contexts of up to ``NEAR`` symbols, after all longer ones have been tested in their subtrees."""
    full = work.table(codes.where("n > 0").groupBy("code").agg(F.sum("n").alias("n")), "contexts")
    short = F.shiftleft(F.shiftright("code", 8 * (DEPTH + 1 - NEAR)), 8 * (DEPTH + 1 - NEAR)).bitwiseOR(F.col("code").bitwiseAND(F.lit(255)))
    found = full.groupBy(short.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = (found.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    near = [Level(code, n, k) for k in range(NEAR + 1)]
    sent = work.spark.sparkContext.broadcast(near)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_subtrees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(subtrees(sent.value, part["code"].to_numpy(), part["n"].to_numpy())[1])], names=["context"])

    kept = by_subtree(full).mapInArrow(needed, "context long").distinct().toArrow()
    tested(near, kept.column("context").to_numpy().astype(np.int64), 1)
    work.drop("contexts")
    return near


def score(docs: DataFrame, trained: Column, name: str = "suffix-tree") -> DataFrame:
    """Token counts, base score and tree score of every row of ``docs``, learning from the rows that meet ``trained``."""
    spark = docs.sparkSession
    work = Workspace(spark, name)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(trained, F.lit(False)).alias("trained"))
    rows = work.table(rows.mapInArrow(_number_blocks, f"block long, doc_id {kind}, text string, trained boolean"), "blocks")
    train = rows.where("trained")
    words = work.table(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = {bytes(r["word"]): r["c"] for r in words.where(F.col("c") >= max(1.0, COMMON * sums["n"])).toLocalIterator()}
    codes = work.table(rows.select("block", "trained", "text").mapInArrow(_count_contexts, "block long, code long, n long"), "codes")
    near, often = spark.sparkContext.broadcast(fit_near(work, codes)), spark.sparkContext.broadcast(common)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_subtrees(batches):
            code, where = np.unique(part["code"].to_numpy(), return_inverse=True)
            n = np.bincount(where, weights=part["n"].to_numpy()).astype(np.int64)
            log_p = log_probabilities(subtrees(near.value, code, n)[0], code)
            yield pa.RecordBatch.from_arrays([part["block"].combine_chunks(), part["code"].combine_chunks(), pa.array(log_p[where].astype(np.float32))], names=["block", "code", "log_p"])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        logs = {word: (c, math.log10(c + 1)) for word, c in often.value.items()}
        code, first = np.unique(found["code"].to_numpy(), return_index=True)
        log_p, places = found["log_p"].to_numpy()[first], Places(code)
        out = []
        for batch in _blocks(texts.to_batches()):
            parts = [tokens(t) for t in batch.column("text").to_pylist()]
            symbols, starts = stream(parts)
            at = scored(starts)
            running = np.zeros(len(symbols) + 1)
            running[at + 1] = log_p[places.find(context_codes(symbols, at))]
            running = np.cumsum(running)
            known, base, rare, times = [], [], [], []
            for ws in parts:
                k, b, rw, rn = 0, 0.0, [], []
                for word, n in Counter([*ws, END]).items():
                    if (found := logs.get(word)) is None:
                        rw.append(word)
                        rn.append(n)
                    else:
                        k += n
                        b += n * found[1]
                known.append(k)
                base.append(b)
                rare.append(rw)
                times.append(rn)
            columns = [batch.column("doc_id"), pa.array([len(ws) + 1 for ws in parts], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(running[starts[1:]] - running[starts[:-1]]), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
            out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "known", "base", "score", "rare", "times"]))
        return pa.Table.from_batches(out)

    priced = by_subtree(codes).mapInArrow(look_up, "block long, code long, log_p float")
    texts = rows.select("block", "doc_id", "text")
    first = texts.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, score double, rare array<binary>, times array<int>")
    first = work.table(first.withColumn("row", F.monotonically_increasing_id()), "first")
    work.drop("blocks", "codes")
    each = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rest = each.join(words, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("part"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + none("more")).alias("n_known"),
        F.lit(int(sums["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + none("part") - F.col("n_tokens") * F.lit(math.log10(sums["n"] + sums["v"] + 1))).alias("base_score"),
        "score",
    )
