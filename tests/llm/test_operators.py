"""Operators of the training-data subpackage against brute force, on awkward small tables."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from photonspark.llm import byte_bpe, chat_format, compression_quality, decontaminate, language_id, near_dedup, quality_rules, suffix_tree, token_orc, warc
from photonspark.llm.components import contract
from photonspark.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, h long, n long, node long, label long"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, near copies, a very long text and odd characters."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    texts = [None, "", " \t\n ", "one", "Ünï čödé 日本語 🎉 ok", " ".join(base), " ".join(near), " ".join(base).upper(), " ".join(base), "x\x1cy a\x0bb\r\nc", "line one\nline one\n\nline one", " ".join(words(2, 30_000, 5000)), "a " * 40]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "clash", 7, 7, 7, 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id text", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0, repr(row))


# -- quality rules ---------------------------------------------------------------------------------


def brute_measure(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures(docs):
    rows = quality_rules.quality_ledger(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((row[0], *brute_measure(row[1])) for row in awkward())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_ablation(docs, empty):
    led = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in led.collect()]
    whole = quality_rules.mask("training", 1)
    for r in quality_rules.ablation(led, "training", 1).collect():
        assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_only_this"] == sum((b & whole) == r["bit"] for b in bits)
        assert r["n_kept_without"] == sum(not b & whole & ~r["bit"] for b in bits)
    assert quality_rules.quality_ledger(empty).count() == 0


# -- language --------------------------------------------------------------------------------------


def test_language_held_out_and_undetermined(docs, empty):
    draw = random.Random(3)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "lich"], "cc": ["eau", "oui", "tre"]}
    make = lambda lang: " ".join("".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(40))
    model = language_id.fit([(make(lang), lang) for lang in syllables for _ in range(30)], n_landmarks=30)
    said, score = language_id.predict(model, [make(lang) for lang in syllables for _ in range(10)])
    assert said == [lang for lang in syllables for _ in range(10)] and all(0 <= s <= 1 for s in score)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(awkward())
    assert sorted(r["doc_id"] for r in rows if r["lang_pred"] == "und") == [0, 1, 2]
    assert language_id.identify(empty, model).count() == 0
    assert set(language_id.predict(language_id.fit([]), ["abc", None])[0]) == {"und"}


def test_language_kernel_matches_brute_force():
    """The score margins are those of the kernel ridge regression computed from set intersections."""
    texts = [("abab cd", "x"), ("abcd ab", "x"), ("zyzy wv", "y"), ("wvzy zy", "y")]
    model = language_id.fit(texts, n_landmarks=4)

    def grams(text):
        s = f" {text} "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    got = [sorted(row) for row in model.kernel([language_id.codes_of(text) for text in ("abcd zy", "wv ab")])]
    want = [sorted(kernel(text, t) for t, _ in texts) for text in ("abcd zy", "wv ab")]
    assert np.allclose(got, want, atol=1e-5)


# -- near-dedup ------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = [(i, near_dedup.exact_shingles(t, size)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            label[high] = low
    return {i: find(i) for i in label}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, docs, size):
    draw = random.Random(size)
    made, base = [], words(9, 150)
    for i in range(160):
        copy = list(base if i % 4 else words(i, 60))
        for _ in range(draw.randrange(9)):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
        made.append((100 + i, " ".join(copy)))
    rows = [(r[0], r[1]) for r in awkward()] + made
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, node int")
    found = near_dedup.near_duplicates(table, words=size).collect()
    want = brute_components(rows, size, 80)
    assert len(found) == len(rows)
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    sizes = Counter((i, len(near_dedup.exact_shingles(t, size))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == sizes


def test_near_duplicates_branch_large_nodes(spark, monkeypatch):
    """With tiny leaves the tree branches further and finds the same components."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    draw, rows, base = random.Random(5), [], words(4, 80)
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randrange(3, 9)):
            copy[draw.randrange(80)] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, 2, 80)


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    work = Workspace(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["vertex"]: r["label"] for r in contract(work, links, "chain").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- byte-level BPE --------------------------------------------------------------------------------


def test_byte_bpe_matches_library(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, ids=True).collect()

    def digest(row):
        ids = library.encode_ordinary(row[1] or "")
        return row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()

    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == Counter(map(digest, awkward()))
    assert all(bytes(r["decoded"]) == library.decode_bytes(r["ids"]) for r in rows)
    assert byte_bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a" * 1500, "aaab" * 60, "thethethe" * 40, "x" * 47 + "yz", "ß" * 300, "1234567890" * 20, "\n" * 200])
def test_byte_bpe_long_words(text):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.codec(path, public_tokenizers.PATTERN).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


# -- WARC ------------------------------------------------------------------------------------------


def test_warc_archive(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://b/4", "small"), (5, "http://b/5", "small"), (None, "http://c", big), (6, "u\r\n\r\nx", big + "other\r\n\r\nbody")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_warc_pushdown_and_foreign_files(spark, tmp_path):
    import gzip

    warc.register(spark)
    plain = [warc.record_bytes({"record_id": f"<r{i}>", "record_type": kind, "target_uri": f"http://h{i}/", "payload": b"x" * 5000, "payload_bytes": 5000}) for i, kind in enumerate(["response", "metadata", "response"])]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, plain)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(warc.member, plain)))
    read = spark.read.format("warc").option("path", f"file://{tmp_path}")
    assert read.load().count() == 9
    chosen = read.load().where("record_type = 'response' AND target_uri LIKE 'http://h2%'")
    assert [(r["record_id"], len(r["payload"])) for r in chosen.collect()] == [("<r2>", 5000)] * 3
    assert read.option("payload", "false").load().where("payload IS NOT NULL").count() == 0
    reader = warc.WarcReader(f"file://{tmp_path}", True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "metadata"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_warc_truncated_and_foreign_bytes(spark, tmp_path):
    import gzip

    warc.register(spark)
    plain = [warc.record_bytes({"record_id": f"<r{i}>", "record_type": "response", "payload": bytes([65 + i]) * 9000}) for i in range(3)]
    whole = {"a.warc": b"".join(plain), "b.warc.gz": b"".join(map(gzip.compress, plain)), "c.warc.gz": b"".join(map(warc.member, plain))}
    for name, data in whole.items():
        for broken, left in ((data[: -len(data) // 6], 2), (data + b"more", 3), (data[:5], 0), (b"", 0), (data, 3)):
            folder = tmp_path / f"{name}-{len(broken)}"
            folder.mkdir()
            (folder / name).write_bytes(broken)
            read = spark.read.format("warc").option("path", f"file://{folder}")
            assert read.option("corrupt", "skip").load().where("length(payload) = 9000").count() == left, (name, len(broken))
            if broken not in (data, b""):
                with pytest.raises(Exception, match="Broken"):
                    read.option("corrupt", "fail").load().count()


# -- suffix tree -----------------------------------------------------------------------------------


def test_suffix_tree_base_and_probabilities(spark, docs, empty):
    rows = suffix_tree.score(docs, F.col("doc_id") % 3 != 1).collect()
    counts = Counter()
    for r in awkward():
        if r[0] is not None and r[0] % 3 != 1:
            counts.update(suffix_tree.tokens(r[1]))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = {}
    for r in awkward():
        ws = [*suffix_tree.tokens(r[1]), "end"]
        want[r[0]] = (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    assert len(rows) == len(awkward())
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3]) and -1e6 < r["score"] < 0
    assert suffix_tree.score(empty, F.lit(True)).count() == 0
    assert suffix_tree.score(docs, F.lit(False)).where("train_tokens = 0 AND n_known = 0").count() == len(awkward())


def test_suffix_tree_longest_suffix_and_normalisation():
    levels = [{0: {97: 60, 98: 40}}, {97: {97: 5, 98: 55}, 98: {97: 38, 98: 2}}, {97 << 8 | 98: {97: 1, 98: 1}}]
    tree = suffix_tree.build_tree([*levels, *({} for _ in range(suffix_tree.DEPTH - 2))])
    unseen = 256 - 2
    for state in range(len(tree.log_p)):
        p = 10.0 ** tree.log_p[state].astype(float)
        assert p[:-1].sum() + unseen * p[-1] == pytest.approx(1, abs=1e-4)
    symbols = np.frombuffer(b"\n\n\n\n\nab", dtype=np.uint8)
    after_a, start = tree.symbol_scores(symbols, np.array([6, 5]))
    root = {97: 61 / 356, 98: 41 / 356}
    assert 10**start == pytest.approx(root[97], rel=1e-4)
    assert 10**after_a == pytest.approx((55 + 2 * root[98]) / 62, rel=1e-4)


# -- decontamination -------------------------------------------------------------------------------


def test_contained_items_match_brute_force(spark, empty):
    draw = random.Random(11)
    items = [(i, " ".join(words(1000 + i, draw.randrange(6, 60), 9000))) for i in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, " ".join(words(77, 20)))]
    rows = [(0, None), (1, ""), (2, "Two  WORDS"), (None, items[3][1])]
    for i in range(60):
        filler, item = words(i, draw.randrange(5, 200), 9000), items[i % 20][1].split()
        at = draw.randrange(len(item))
        if i % 3 == 0:
            item = item[: max(5, int(len(item) * draw.choice([0.5, 0.8, 0.9])))]
        if i % 5 == 0:
            item[at % len(item)] = "changed"
        rows.append((10 + i, " ".join(filler[:50] + item + filler[50:]).replace("w1", "W1")))
    rows.append(rows[-1])

    def grams(text):
        ws = (text or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    want = {}
    for (d, text), (i, item) in itertools.product(rows, items):
        g = grams(item)
        if g and 100 * len(g & grams(text)) >= 80 * len(g):
            want[d, i] = (len(g), len(g & grams(text)))
    documents = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, h string")
    found = decontaminate.contained_items(documents, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in found} == want and len(found) == len(want)
    assert decontaminate.contained_items(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


# -- chats -----------------------------------------------------------------------------------------

PARAMETERS = {"chars": ("integer", True, {"minimum": 0, "maximum": 300}), "text": ("string", True, {"maxLength": 300})}


def test_chat_links_levels_and_json(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "é"\n'), (1, 2, "assistant", "a"), (1, 3, "user", "again"), (1, 4, "assistant", "b"), (2, 0, "assistant", "orphan"), (2, 3, "user", None), (None, 1, "user", "x"), (3, 0, None, ""), (1, 4, "assistant", "b")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = chat_format.format_chats(chat_format.from_turns(table), PARAMETERS, "reply").collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert [by[1, t]["level"] for t in range(5)] == [0, 0, 1, 2, 3]
    assert [by[1, t]["linked_turn"] for t in range(5)] == [None, 2, 1, 4, 3]
    assert by[2, 0]["linked_turn"] is None and by[2, 3]["valid"] is False and by[1, 1]["valid"] is True and by[1, 2]["valid"] is None
    for r in got:
        text = r["json"]
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(by[1, 1]["json"])["arguments"] == {"chars": 6, "text": 'q "é"\n'}
    assert chat_format.format_chats(chat_format.from_turns(table.where("false")), PARAMETERS, "reply").count() == 0


@pytest.mark.parametrize(("arguments", "valid"), [('{"text":"a","chars":1}', True), ('{"chars":"1","text":"a"}', False), ('{"chars":1}', False), ('{"chars":1,"text":"a","more":2}', False), ("[1]", False), ("{bad", False), (None, False), ('{"text":"a","chars":301}', False), ('{"text":"a","chars":-1}', False), ('{"text":"' + "é" * 300 + '","chars":300}', True), ('{"text":"' + "é" * 301 + '","chars":300}', False)])
def test_chat_schema_validation(spark, arguments, valid):
    df = spark.createDataFrame([(arguments,)], "arguments string")
    assert df.select(chat_format.valid_arguments("arguments", PARAMETERS)).first()[0] is valid


def test_chat_cycles_have_no_level(spark):
    work = Workspace(spark, "test")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "d")], "node string, parent string")
    got = {r["node"]: r["level"] for r in chat_format.levels(work, edges).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 0, "e": 1}


# -- token files -----------------------------------------------------------------------------------


def test_token_orc_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows, start, want = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in token_orc.encode_to_orc(docs, path).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_orc.encode_to_orc(empty, path).count() == 0


def test_token_orc_lookup(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_orc.write(docs, f"file://{tmp_path}/ids", path)
    assert [r["ids"] for r in token_orc.lookup(spark, f"file://{tmp_path}/ids", [3]).collect()] == [np.frombuffer(token_orc.encode(path, ["one"])[0], "<u4").tolist() + [1]]
    plan = token_orc.lookup(spark, f"file://{tmp_path}/ids", [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan or "PushedFilters: [In(doc_id" in plan


# -- compression classifier ------------------------------------------------------------------------


def test_compression_quality_held_out(spark, docs, empty):
    draw = random.Random(8)
    good = lambda: " ".join(draw.choice(["river", "stone", "garden", "window", "letter", "morning"]) for _ in range(60))
    bad = lambda: " ".join(draw.choice(["BUY!!", "$$$", "click", "###", "WIN%%"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:300]] + [(1, 0), (2, None)], "doc_id long, quality int")
    model = compression_quality.fit(*compression_quality.training_rows(table, labels, F.lit(True)))
    got = {r["doc_id"]: r for r in compression_quality.classify(table, model).collect()}
    assert sum(got[i]["predicted"] == i % 2 for i in range(300, 400)) >= 98
    scored = compression_quality.classify(docs, model).collect()
    assert len(scored) == len(awkward()) and all(0 <= r["score"] <= 1 for r in scored)
    assert compression_quality.classify(empty, model).count() == 0
    none = compression_quality.fit(*compression_quality.training_rows(table, labels.where("false"), F.lit(True)))
    assert none.probability(0.0) == pytest.approx(0.5)
