"""Words reach the tokenizer's model by short ways with the same ids."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

from photonspark.llm import token_orc, workspace


def test_words_of():
    for words in ([], [""], ["a"], ["", "b", "ü\xa0", ""]):
        assert workspace.words_of(pa.array(words, pa.string())) == words


def test_words_before_marks_need_no_splitter(monkeypatch):
    coder, split = token_orc.Coder(public_tokenizers.path("word_bpe_49k.json")), []
    inner = coder.split
    monkeypatch.setattr(coder, "split", lambda word: split.append(word) or inner(word))
    words = ["river,", "river.!?", "rivers'", "the-", "it's", "a.b", "x2,", "...", "'s'", "naïve,", "!river"]
    want = [coder.whole(w) for w in words]
    assert [coder.word(w) for w in words] == want
    assert split == ["it's", "a.b", "x2,", "...", "'s'", "naïve,", "!river"]
