from __future__ import annotations

import os
import random

import pytest

from newsloom.llm.tokenize import default_vocabulary, encode_corpus, load

pytestmark = pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary file here")
TEXTS = ["", " ", "Hello world", "it's  'S 's\n's  \t\n", "a" * 300, "=-" * 100, "7779 2222", "新闻网记者报道", "เทียโพลสภา", "नोरसाव तीरनोर ने", "<|endoftext|> x", "　 \xa0 x", "Ünïcödé 🏴󠁧󠁢", "x" * 5000, "​﻿", "ﬁ́"]


def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(default_vocabulary())
    reference.encode_special_tokens = True
    encoder = load(default_vocabulary())
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab 1.\n'é中の́🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text, expected in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == expected.ids, text[:60]


def test_round_trip():
    encoder = load(default_vocabulary())
    assert all(encoder.decode(encoder.encode(t)) == t for t in TEXTS)


def test_automaton_accepts_one_path_only():
    encoder = load(default_vocabulary())
    a = encoder.automaton
    ids = encoder.encode(" morning")
    state = 0
    for i in ids:
        assert a.has_arc(state, i)
        state = a.leads_to[i]
    t, h = a.id_of[b"t"], a.id_of[b"h"]
    assert not a.has_arc(a.leads_to[t], h)  # "th" merges


def test_corpus_cases(spark):
    rows = [(1, "Hello", "x"), (2, "", None), (3, None, None), (1, "Hello", "x"), (4, " ", "y")]
    found = sorted((r.doc_id, r.ids) for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect())
    encoder = load(default_vocabulary())
    assert found == [(1, encoder.encode("Hello")), (1, encoder.encode("Hello")), (2, []), (3, []), (4, encoder.encode(" "))]
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
