"""Token ids are those of the tokenizers library on whole texts, word by word or not."""

from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest

from photonspark.llm import token_orc

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"abcXYZäöüßÄÉéøŁłşİıǅſΣσς0123456789.,;:!?'\"-_()<|>", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "́", "̇", "̈", "漢", "字", "か", "한", "א", "ب", "व", "Å", "ﬁ", "𝔸", "😀", "'s", "'ll", "'re ", "<|endoftext|>", "ab.", "Ab, ", "a.b", ". ", ", ", "the ", "Straße", "x²", "½"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def random_texts(n: int) -> list[str | None]:
    draw = random.Random(n)
    return ["".join(draw.choices(PARTS, k=draw.randrange(40))) for _ in range(n)] + ["", None, " ", "  a  b ", " .", "a.", "a.,", ",a", "word " * 200_000]


def test_ids_equal_the_library_on_awkward_texts(library):
    assert token_orc.coder(PATH).by_word
    texts = random_texts(20_000)
    for text, got in zip(texts, token_orc.encode(PATH, texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(token_orc, "CACHED", 50)
    texts = random_texts(500)
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert [np.frombuffer(x, "<u4").tolist() for x in token_orc.encode(PATH, part)] == [library.encode(t or "", add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"post_processor": {}}, {"truncation": {}}])
def test_other_tokenizers_encode_whole_texts(tmp_path, change):
    spec = json.load(open(PATH, encoding="utf-8"))
    assert token_orc.by_word(spec) and not token_orc.by_word(spec | change)
    if change == {"normalizer": None}:
        from tokenizers import Tokenizer

        (tmp_path / "other.json").write_text(json.dumps(spec | change), encoding="utf-8")
        other = Tokenizer.from_file(str(tmp_path / "other.json"))
        texts = random_texts(300)
        assert [np.frombuffer(x, "<u4").tolist() for x in token_orc.encode(str(tmp_path / "other.json"), texts)] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]
