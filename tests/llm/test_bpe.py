"""Byte-level BPE beside the library's own answers, and exact round trips."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pytest

from loomvec.llm import bpe


def library():
    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_equals_library_and_round_trip(spark, small):
    docs = small("documents")
    encoded = bpe.encode(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = library()
    for r in encoded.collect():
        assert r.token_ids == own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids) == len(r.char_start) == len(r.char_end)
        assert r.round_trip and r.char_start[0] == 0 and r.char_end[-1] == len(texts[r.doc_id])
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == texts


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    # letters that Unicode added after the library's tables were made may be split otherwise
    if any(unicodedata.category(c) == "Cn" for c in text):
        return
    n, ids, start, end, same = bpe.encode_slice(bpe.vocabulary(bpe.DEFAULT_VOCABULARY), [text, None, ""])
    assert same.to_pylist() == [True] * 3 and n.to_pylist()[1:] == [0, 0]
    assert ids.to_pylist()[1:] == [None, []]
    table = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    raw, at = text.encode(), 0
    for i, a, b in zip(ids.to_pylist()[0], start.to_pylist()[0], end.to_pylist()[0]):
        piece = table.decode(__import__("numpy").array([i])).tobytes()
        assert raw[at : at + len(piece)] == piece
        touched = [k for k, c in enumerate(text) if len(text[:k].encode()) < at + len(piece) and len(text[: k + 1].encode()) > at]
        assert (a, b) == (touched[0], touched[-1] + 1)
        at += len(piece)
    assert at == len(raw)


def test_defined_results(odd_docs, no_docs):
    found = bpe.encode(odd_docs)
    assert found.columns == ["doc_id", "n_tokens", "token_ids", "char_start", "char_end", "round_trip"]
    rows = found.collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    null, empty = (next(r for r in rows if r.doc_id == i) for i in (3, 4))
    assert null.token_ids is None and null.n_tokens == 0 and empty.token_ids == []
    assert bpe.encode(no_docs).count() == 0
    assert {r.doc_id: r.text for r in bpe.decode(found).collect()} == {r.doc_id: r.text for r in odd_docs.collect()}


def test_split_character_and_specials():
    table = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    n, ids, start, end, same = bpe.encode_slice(table, ["\U0001f9ff <|endoftext|>"])
    assert same.to_pylist() == [True] and 50256 not in ids.to_pylist()[0]
    assert start.to_pylist()[0][:2] == [0, 0]  # one character, several tokens


def test_counts_and_other_vocabularies(spark):
    df = spark.createDataFrame([(1, "some words here", 3), (2, None, 4), (3, "", 5), (4, "é" * 2_000_000, 6)], "doc_id bigint, text string, n_tokens int")
    expected = {r.doc_id: r.n_tokens for r in bpe.encode(df.drop("n_tokens")).collect()}
    rows = bpe.with_counts(df, "n").collect()
    assert {r.doc_id: r.n for r in rows} == expected and [r.n_tokens for r in rows] == [3, 4, 5, 6]
    with pytest.raises(ValueError, match="no plain byte-level"):
        bpe.ByteBpe("/opt/tokenizers/word_bpe_49k.json")
