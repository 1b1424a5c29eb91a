import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelog.llm import sentencepieces as S

PATH = public_tokenizers.path(S.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    for text, ids in zip(texts, S.Encoder(PATH).encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text[:80]
        assert S.pieces(PATH).decode(ids) == library.decode(want), text[:80]


ODD = ["", " ", "  ", "\n", "a\n b\n\n c", " x", "▁a", "a▁▁b", "<s>", "</s> <unk>", "a\0b", "ﬁ①", " x", "x" * 999, " " * 77 + "a" + " " * 18,
       "aaaa aaaab ababab", "1234567890" * 20, "日本語のテキスト", "🙂🙃 é", "�﻿", "\t\ttab", "ñandú Über straße", "<0x41>", "the " * 500]


def test_odd_texts_equal_the_library(library):
    same(library, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet=" ab\n▁é.thein", max_size=80)), max_size=6))
def test_any_texts_equal_the_library(library_texts):
    same(sentencepiece.SentencePieceProcessor(model_file=PATH), library_texts)


def test_decoding_loose_bytes_equals_the_library(library):
    pieces = S.pieces(PATH)
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.choice([*pieces.byte_ids[100:], 1, 2, *rng.integers(259, 32000, 30)], rng.integers(0, 12))
        assert pieces.decode(np.array(ids, np.int64)) == library.decode([int(i) for i in ids]), ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(S, "MEMORY", 3)
    encoder = S.Encoder(PATH)
    for _ in range(2):
        for text in ODD:
            assert encoder.encode([text])[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_table_with_nulls_and_repeated_rows(spark, library):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6), (3, "", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, S.encode_texts(docs, PATH).collect()), key=str)
    empty = (2, hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest(), hashlib.sha256(b"").hexdigest())
    assert rows[:2] == [(1, *empty)] * 2 and (3, *empty) in rows and len(rows) == 4
    assert S.encode_texts(docs.limit(0), PATH).count() == 0
