"""MinHash near-duplicates by a chosen-path set similarity join.

1. A document's set: distinct shingles of ``words`` words (A-Z lowered), as 64-bit hashes. It gives
   a 128-bit digest, ``COORDINATES`` minhashes and a sketch of two bits of each. Documents with the
   same digest are one class; only its smallest id goes on. Classes of one id are linked at once.
2. Chosen paths: ``trees`` independent trees, each with minhashes of its own, branch every
   representative by ``BRANCH`` minwise tokens a node, chosen by a hash of the node; a path of
   ``DEPTH`` tokens is a leaf. A pair of Jaccard similarity J shares a leaf of one tree with
   probability p(DEPTH), p(0) = 1, p(d) = 1 - (1 - J p(d - 1))**BRANCH; ``trees`` is the least
   number that reaches the target recall.
3. Star rounds: in every node that holds several components, each member is paired with the node's
   pivot (other pivots every round), at most one pair a document and round. Pairs pass a size and a
   sketch filter, are confirmed on the shingles of the texts, and merge components. A large group
   of near copies costs one pair a member and round this way.
4. Nodes of at most ``LEAF`` members that still hold several components are compared exhaustively:
   rows with a close partner of another component in a node make families (connected through
   nodes). A family's rows outside its largest component ask, all its rows are held; both sides are
   cut into blocks of at most ``HELD`` shingles, and a task compares one block of askers with one
   block of held rows, so its memory does not depend on the family. Tasks return links that join
   components, confirmed on the shingles of the texts, and no pairs. Nodes of over ``LEAF`` members
   branch further and run through 3 and 4 again; those left at ``MAX_DEPTH`` are compared whatever
   their size, so nothing is cut off.

A hot class or pivot meets partial aggregations; a hot node is dealt to tasks of about ``SPREAD``
rows; only links and labels grow with it, linearly.

Defined results: null or empty texts have an empty set and are linked with nothing, even where
their id repeats; texts with fewer words than a shingle are one shingle of the whole sequence; rows
of one id (with words) are one vertex, whose links are those of all its texts; rows with a null id
link nothing, keep a null component and are kept; repeated rows get the same result each; an empty
table gives an empty result. Other input columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.components import contract
from photonspark.llm.workspace import Workspace, released, words_of

COORDINATES = 128
BRANCH = 2
DEPTH = 3
LEAF = 2048
MAX_DEPTH = 16
STAR_ROUNDS = 2
#: Shingles of a block of an exhaustive comparison, where every row counts as ``ROW_COST`` more.
HELD = 250_000
ROW_COST = 100
#: Rows of one node that a task of a join by node gets.
SPREAD = 512
SKETCHES = ["s0", "s1", "s2", "s3"]
SMALL_ROWS = 1_000_000

_U = np.uint64
_ONE, _TWO, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed values: its two multipliers and the increment)."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _ONE
    x = (x ^ (x >> _U(27))) * _TWO
    return x ^ (x >> _U(31))


_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | _U(1)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(size, len(words))
    out = np.full(len(each) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out ^ each[k : len(each) - width + 1 + k])
    return np.unique(out)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """``shingle_set`` of the words of each text: a distinct word of the block is hashed once, and shingles are mixed for all texts at once."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    distinct = words_of(coded.dictionary)
    at, ends = coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
    real = np.array([bool(w) for w in distinct], dtype=bool)[at]  # white space at an end of a text leaves an empty word
    ends = np.r_[0, np.cumsum(real)][ends].tolist()
    each = np.array([xxhash.xxh64_intdigest(w.encode()) for w in distinct], dtype=np.uint64)[at[real]]
    full = np.full(max(0, len(each) - size + 1), size, dtype=np.uint64)
    for k in range(size if len(full) else 0):
        full = mix(full ^ each[k : len(full) + k])
    out = []
    for start, stop in zip(ends[:-1], ends[1:]):
        if stop - start >= size:
            found = np.sort(full[start : stop - size + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        else:
            found = np.full(min(1, stop - start), stop - start, dtype=np.uint64)
            for k in range(start, stop):
                found = mix(found ^ each[k])
            out.append(found)
    return out


def exact_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The set that a text stands for."""
    words = tokens(text)
    width = min(size, len(words))
    return set(zip(*(words[k:] for k in range(width))))


def similar(left: list[bytes], right: list[bytes], size: int, percent: int) -> bool:
    """Whether two word sequences share enough of their distinct shingles; exact, without hashes."""
    if min(len(left), len(right)) < size:
        return bool(left) and left == right
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in (left, right) for w in words), np.int64, len(left) + len(right))
    code, most = ids, len(number)
    for k in range(1, size):
        if most * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            most = int(code.max()) + 1
        code = code[:-1] * len(number) + ids[k:]
        most *= len(number)
    mine, other = np.unique(code[: len(left) - size + 1]), np.unique(code[len(left) :])
    both = len(np.intersect1d(mine, other, assume_unique=True))
    return 100 * both >= percent * (len(mine) + len(other) - both)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):  # so few that both arrays stay in the processor's cache
        part = shingles[at : at + 256, None] * _FACTORS
        part ^= part >> _U(29)
        np.minimum(best, part.min(axis=0), out=best)
    return (best >> _U(32)).astype(np.uint32)


def paths(signatures: np.ndarray, trees: int) -> np.ndarray:
    """Leaf ids of all trees: one row a document. A tree has minhashes of its own (up to 16 trees), and the branches of a node differ."""
    rows, own = np.arange(len(signatures))[:, None], max(8, COORDINATES // trees)
    nodes = np.broadcast_to(mix(np.arange(trees, dtype=np.uint64)), (len(signatures), trees))
    first = np.arange(trees, dtype=np.uint64) * _U(own)
    for _ in range(DEPTH):
        children, chosen = [], mix(nodes ^ _ONE) % _U(own)
        for k in range(BRANCH):
            token = ((first + (chosen + _U(k * own // BRANCH)) % _U(own)) % _U(COORDINATES)).astype(np.int64)
            children.append(mix(nodes ^ mix(signatures[rows, token].astype(np.uint64) | (token.astype(np.uint64) << _U(32)))))
        nodes, first = np.concatenate(children, axis=1), np.tile(first, BRANCH)
    return nodes


def trees_for(recall: float, threshold: float) -> int:
    reached = 1.0
    for _ in range(DEPTH):
        reached = 1 - (1 - threshold * reached) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - reached)))


def sketch_limit(threshold: float) -> int:
    """Differing sketch bits up to which a pair goes on: 4.5 standard deviations beyond the mean at the threshold."""
    off = 1 - threshold
    return math.ceil(COORDINATES * off + 4.5 * math.sqrt(COORDINATES * (1.5 * off - off * off)))


def _fingerprints(docs: DataFrame, size: int, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1), size)
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                signature = np.array([minhashes(s) for s in sets], dtype=np.uint32).reshape(-1, COORDINATES)
                bits = np.stack([signature & 1, (signature >> 1) & 1], axis=2).reshape(len(sets), -1).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                nodes = paths(signature, trees).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64() if x.dtype == np.int64 else pa.int32())) for x in (signature.view(np.int32), np.ascontiguousarray(nodes))]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d0", "d1", *SKETCHES, "signature", "nodes"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_shingles long, d0 long, d1 long, {', '.join(f'{s} long' for s in SKETCHES)}, signature array<int>, nodes array<long>"
    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def _close(percent: int, mine: str = "", other: str = "h_") -> Column:
    """Size and sketch filter between the columns of two rows, told apart by their prefixes."""
    n, m = F.col(f"{mine}n"), F.col(f"{other}n")
    apart = sum((F.bit_count(F.col(f"{mine}{s}").bitwiseXOR(F.col(f"{other}{s}"))) for s in SKETCHES), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= sketch_limit(percent / 100))


class Overlaps:
    """Sizes of intersections in a bounded list of sets, some rows at a time.

    Shingles of few sets are counted by their lists of sets, frequent ones by a matrix product.
    """

    def __init__(self, sets: list[np.ndarray], dense_from: int = 9):
        value = np.concatenate(sets)
        order = np.argsort(value, kind="stable")
        value = value[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        del order
        self.n, self.starts = len(sets), np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        self.times = np.diff(np.r_[self.starts, len(value)])
        self.rare = [self.owner[self.starts[self.times == n][:, None] + np.arange(n)] for n in range(2, dense_from)]
        self.often = np.flatnonzero(self.times >= dense_from)

    def counts(self, rows: np.ndarray, columns: int = 512) -> np.ndarray:
        """Shared elements of the sets ``rows`` with all sets (of a set with itself: too few, and of no use)."""
        out = np.zeros((len(rows), self.n), dtype=np.float32)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        for lists in self.rare:
            for k in range(lists.shape[1]):
                mine = place[lists[:, k]]
                use = np.flatnonzero(mine >= 0)
                np.add.at(out.ravel(), (mine[use, None] * self.n + lists[use]).ravel(), 1)
        for at in range(0, len(self.often), columns):
            part = self.often[at : at + columns]
            size = self.times[part]
            every = np.zeros((self.n, len(part)), dtype=np.float32)
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            every[self.owner[np.repeat(self.starts[part], size) + within], np.repeat(np.arange(len(part)), size)] = 1
            out += every[rows] @ every.T
        return out


def family_links(texts: list[bytes], components: list, asks: list[bool], words: int, percent: int, block: int = 256) -> list[tuple[int, int]]:
    """Links of the rows that ask, as few as join what their links join; each is confirmed on the words."""
    hashes, parts = WordHashes(), [text.split() for text in texts]
    sets = [shingle_set(p, words, hashes) for p in parts]
    del parts
    label = np.unique(np.array(components), return_inverse=True)[1]
    lengths, asking = np.array([len(s) for s in sets]), np.flatnonzero(asks)
    overlaps, links = Overlaps(sets), []
    del sets
    for at in range(0, len(asking), block):
        rows = asking[at : at + block]
        if len(np.unique(label)) < 2:
            break
        shared = np.rint(overlaps.counts(rows)).astype(np.int32)
        close = 100 * shared.astype(np.int64) >= percent * (lengths[rows, None] + lengths[None, :] - shared)
        for k, row in enumerate(rows):
            others = np.flatnonzero(close[k] & (label != label[row]))
            while len(others):
                other, others = others[0], others[1:]
                if similar(texts[row].split(), texts[other].split(), words, percent):
                    links.append((int(row), int(other)))
                    label[label == label[other]] = label[row]
                    others = others[label[others] != label[row]]
    return links


def spread_join(rows: DataFrame, per_node: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with at most one row a node, both with the node's ``size``; a large node is dealt to several tasks."""
    deals = F.ceil(F.col("size") / SPREAD)
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("rep"), deals))
    copies = per_node.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("size")
    return dealt.join(copies, ["node", "deal"], how).drop("deal")


class Join:
    """State of one run: representatives, texts, links and components."""

    def __init__(self, docs: DataFrame, words: int, percent: int, recall: float):
        self.spark, self.docs, self.words, self.percent = docs.sparkSession, docs, words, percent
        self.work = Workspace(self.spark, "near-dedup")
        prints = self.work.table(_fingerprints(docs, words, trees_for(recall, percent / 100)), "prints")
        self.members = prints.select("doc_id", "n_shingles", "d0", "d1")
        full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        classes = self.members.where(full).groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"))
        self.classes = self.work.table(classes, "classes")
        mine = self.classes.select(F.col("rep").alias("doc_id"), "d0", "d1")
        reps = prints.where(full).join(mine, ["doc_id", "d0", "d1"], "left_semi")
        self.reps = self.work.table(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *SKETCHES, "signature", "nodes"), "reps")
        self.tried: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.turn = self.n_live = self.n_links = 0
        self.link_ids(full)

    def link_ids(self, full: Column) -> None:
        """Rows of one id with different texts are one vertex: link the representatives of their classes."""
        differ = (F.min("d0") != F.max("d0")) | (F.min("d1") != F.max("d1"))
        several = self.members.where(full).groupBy("doc_id").agg(differ.alias("differ")).where("differ").select("doc_id")
        several = self.work.table(several, "several")
        n = several.count()
        if n:
            held = self.members.where(full).join(several, "doc_id", "left_semi").join(self.classes, ["d0", "d1"]).select("doc_id", "rep").distinct()
            held = self.work.table(held, "held")
            least = held.groupBy("doc_id").agg(F.min("rep").alias("least"))
            self.merge(held.join(least, "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), held.count())

    def name(self, what: str) -> str:
        return f"{what}-{self.turn}"

    # -- nodes ---------------------------------------------------------------------------------
    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes with two members or more, with the node's size."""
        shared = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        live = self.work.table(rows.join(shared, "node"), self.name("live"))
        self.n_live = live.count()
        return live

    def unresolved(self, live: DataFrame) -> DataFrame:
        """Rows of nodes that hold several components, with the row's component."""
        if self.labels is None:
            return live.withColumn("component", F.col("rep"))
        labelled = live.join(self.labels, F.col("rep") == F.col("vertex"), "left").withColumn("component", F.coalesce("label", "rep")).drop("vertex", "label")
        labelled = self.work.table(labelled, self.name("labelled"), self.n_live)
        mixed = labelled.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size")).where("low != high").select("node", "size")
        return self.work.table(spread_join(labelled, mixed, "left_semi"), self.name("mixed"), self.n_live)

    # -- pairs ---------------------------------------------------------------------------------
    def star(self, rows: DataFrame, seed: int) -> DataFrame:
        """At most one pair for each representative: the first pivot, in one order of all, among those of its nodes."""
        ranked = rows.withColumn("rank", F.xxhash64(F.lit(seed), "rep"))
        head = [F.min_by(c, "rank").alias(f"h_{c}") for c in ("rep", "component", "n", *SKETCHES)]
        heads = ranked.groupBy("node").agg(F.max("size").alias("size"), F.min("rank").alias("h_rank"), *head)
        other = (F.col("component") != F.col("h_component")) & _close(self.percent)
        return spread_join(ranked, heads).where(other).groupBy(F.col("rep").alias("x")).agg(F.min_by("h_rep", "h_rank").alias("p"))

    # -- confirmation --------------------------------------------------------------------------
    def confirm(self, pairs: DataFrame) -> bool:
        """Confirm new pairs on the words and merge components; false if there was no link."""
        self.turn += 1
        ordered = pairs.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).where("a != b").distinct()
        if self.tried is not None:
            ordered = ordered.join(self.tried, ["a", "b"], "left_anti")
        ordered = self.work.table(ordered, self.name("pairs"), self.n_live)
        self.tried = ordered if self.tried is None else self.tried.unionByName(ordered)
        n = ordered.count()
        if not n:
            return False
        ids = ordered.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = self.texts_of(ids, n, self.name("texts"))
        left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        size, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similar(tokens(ta.as_py()), tokens(tb.as_py()), size, percent) for ta, tb in zip(batch.column(2), batch.column(3))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        kind = dict(self.docs.dtypes)["doc_id"]
        joined = ordered.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        linked = self.merge(joined.mapInArrow(released(run), f"a {kind}, b {kind}").distinct(), n)
        self.work.drop(self.name("texts"))
        return linked

    def merge(self, links: DataFrame, rows: int) -> bool:
        """Add links, of which there are about ``rows`` at most: only they are contracted, between components. False without links."""
        found = self.work.table(links, self.name("links"))
        if found.isEmpty():
            return False
        self.n_links += rows
        if self.labels is None:
            self.labels = contract(self.work, found, self.name("component"), rows)
            return True
        old = self.labels
        ends = [old.select(F.col("vertex").alias(f"v{k}"), F.col("label").alias(f"l{k}")) for k in "ab"]
        moved = found.join(ends[0], F.col("a") == F.col("va"), "left").join(ends[1], F.col("b") == F.col("vb"), "left")
        new = contract(self.work, moved.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), self.name("component"), rows)
        renamed = new.select(F.col("vertex").alias("v"), F.col("label").alias("l"))
        kept = old.join(renamed, F.col("label") == F.col("v"), "left").select("vertex", F.coalesce("l", "label").alias("label"))
        fresh = new.join(old.select(F.col("vertex").alias("v")), F.col("vertex") == F.col("v"), "left_anti")
        self.labels = self.work.table(kept.unionByName(fresh), self.name("labels"), 2 * self.n_links)
        return True

    def texts_of(self, ids: DataFrame, rows: int, name: str) -> DataFrame:
        """Texts of representatives: one row a distinct ``(doc_id, text)``."""
        if rows <= SMALL_ROWS:  # checked; else both sides are shuffled
            ids = F.broadcast(ids)
        return self.work.table(self.docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").distinct(), name)

    def families(self, rows: DataFrame) -> None:
        """Compare nodes exhaustively and merge what is linked."""
        self.turn += 1
        near = (F.col("l.node") == F.col("r.node")) & (F.col("l.component") != F.col("r.component")) & _close(self.percent, "l.", "r.")
        close = self.work.table(rows.alias("l").join(rows.alias("r"), near, "left_semi"), self.name("close"), self.n_live)
        n_close = close.count()
        if not n_close:
            return
        heads = close.groupBy("node").agg(F.min("rep").alias("head"))
        edges = close.join(heads, "node").select(F.col("rep").alias("a"), F.col("head").alias("b"))
        label = contract(self.work, edges, self.name("family"), n_close)
        members = close.select("rep", "n", "component").distinct().join(label, F.col("rep") == F.col("vertex")).select("rep", "n", "component", F.col("label").alias("family"))
        members = self.work.table(members, self.name("members"), n_close)
        n = members.count()
        tasks = self.tasks(members)
        texts = self.texts_of(members.select(F.col("rep").alias("doc_id")), n, self.name("texts"))
        size, percent = self.words, self.percent
        kind = dict(self.docs.dtypes)["doc_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, reps, parts, asks, texts = None, [], [], [], []

            def links() -> pa.RecordBatch:
                found = family_links(texts, parts, asks, size, percent) if len(texts) > 1 else []
                return pa.RecordBatch.from_arrays([pa.array([reps[p[k]] for p in found], reps_type) for k in (0, 1)], names=["a", "b"])

            for batch in batches:
                reps_type = batch.column(3).type
                for *task, rep, part, ask, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if task != own:
                        if texts:
                            yield links()
                        own, reps, parts, asks, texts = task, [], [], [], []
                    reps.append(rep)
                    parts.append(part)
                    asks.append(ask)
                    texts.append(b" ".join(tokens(text)))
            if texts:
                yield links()

        held = tasks.join(texts, F.col("rep") == F.col("doc_id")).select("family", "q", "d", "rep", "component", "asks", "text")
        ordered = held.repartition("family", "q", "d").sortWithinPartitions("family", "q", "d", "rep")
        self.merge(ordered.mapInArrow(released(run), f"a {kind}, b {kind}").distinct(), n)
        self.work.drop(self.name("texts"))

    def tasks(self, members: DataFrame) -> DataFrame:
        """(family, q, d, rep, component, asks): the rows of each task, which compares block q of a family's askers with block d of its rows."""
        order = F.struct("many", "component")
        parts = members.groupBy("family", "component").agg(F.count("*").alias("many"), F.sum(F.col("n") + ROW_COST).alias("weight"))
        whole = parts.groupBy("family").agg(F.max_by("component", order).alias("largest"), F.sum("weight").alias("all"), (F.sum("weight") - F.max_by("weight", order)).alias("outside"))
        blocks = whole.select("family", "largest", F.ceil(F.col("outside") / HELD).alias("n_q"), F.ceil(F.col("all") / HELD).alias("n_d"))
        placed = members.join(blocks, "family").withColumn("asks", F.col("component") != F.col("largest"))
        alone = (F.col("n_d") == 1) & (F.col("n_q") == 1)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        one = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n))
        held = placed.select("family", every("n_q").alias("q"), one("n_d", 0).alias("d"), "rep", "component", (F.col("asks") & alone).alias("asks"))
        asking = placed.where(F.col("asks") & ~alone).select("family", one("n_q", 1).alias("q"), every("n_d").alias("d"), "rep", "component", "asks")
        return held.unionByName(asking)

    def branch(self, rows: DataFrame) -> DataFrame:
        """Children of nodes: each row goes down ``BRANCH`` tokens that the node chooses."""
        wide = rows.drop("size", "component").join(self.reps.select(F.col("rep").alias("of"), "signature"), F.col("rep") == F.col("of")).drop("of")
        token = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int")
        down = [F.xxhash64("node", token(k), F.element_at("signature", token(k) + 1)) for k in range(BRANCH)]
        return wide.withColumn("node", F.explode(F.array(*down))).drop("signature")

    def run(self) -> DataFrame:
        rows = self.reps.select("rep", "n", *SKETCHES, F.explode("nodes").alias("node"))
        for depth in range(DEPTH, MAX_DEPTH + 1):
            live = self.live(rows)
            if not self.n_live:
                break
            for k in range(STAR_ROUNDS):
                if not self.confirm(self.star(self.unresolved(live), 1000 * depth + k)):
                    break
            mixed = self.unresolved(live)
            small = mixed if depth == MAX_DEPTH else mixed.where(F.col("size") <= LEAF)
            self.families(small)
            large = mixed.where(F.col("size") > LEAF)
            if depth == MAX_DEPTH or large.isEmpty():
                break
            rows = self.branch(large)
        labels = self.labels
        reps = self.members.join(self.classes, ["d0", "d1"], "left")
        if labels is not None:
            reps = reps.join(labels, F.col("rep") == F.col("vertex"), "left").withColumn("rep", F.coalesce("label", "rep"))
        found = reps.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))
        return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every row."""
    return Join(docs, words, percent, recall).run()
