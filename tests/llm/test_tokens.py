"""Ids against another library, round trips, and texts of every kind."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import tokens as K

TEXTS = [None, "", " ", "\n\n  \t", "plain words, it's fine.", "<|endoftext|> is text", "最大回撤达到44.3%，随后修复。", "naïve café  à 8 421,1", "a" * 50_000, "x\u0000y", "🙂👩‍👩‍👧 ​﻿퟿", "\r\n\r\n", "ｆｕｌｌ　ｗｉｄｔｈ", "<unk> </s>"]


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.serialise_model(K.read_ranks()))


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {token: rank for rank, token in enumerate(K.read_ranks())}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_rank_library(encoder, other):
    some = [t for t in TEXTS if t is not None and len(t) < 10_000]
    assert encoder.encode_all(some) == [other.encode_ordinary(t) for t in some]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_round_trips(encoder, other, text):
    ids = encoder.encode_all([text])[0]
    assert ids == other.encode_ordinary(text)
    assert encoder.decode(ids) == text


def test_frame(spark):
    rows = [(k, t, 7) for k, t in enumerate(TEXTS)] + [(0, None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = K.token_ids(df)
    assert out.columns == ["doc_id", "text", "ids"] and out.count() == len(rows)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[0] == [] and got[1] == [] and got[2] == [220] and len(got[8]) > 5000
    counts = {r.doc_id: r.n_tokens for r in K.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert K.token_ids(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.token_ids(df, "nothing")


def test_memory_limit_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(K, "KEPT", 3)
    some = ["one two three", "four five six", "one two six"]
    assert [encoder.encode_all([t])[0] for t in some] == encoder.encode_all(some)
