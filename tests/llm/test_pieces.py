import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from fleetlens.llm import pieces, queries

PATH = queries.piece_model_path()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return pieces.PieceModel(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    "", " ", "  ", "a", " a", "  a  b ", "a\nb", "\n", "\n\n a", "\t", "▁x", "x▁ ▁y", "é日本\U0001f600",
    "\x00a", "<s>a</s>", "<0x0A>", "<unk>", "1234567", "a" * 300, " " * 70, "中文" * 50, "é　x", "\r\n z", "﻿q",
]


def test_odd_texts_equal_the_library(model, library):
    for text, ids in zip(ODD, model.encode(ODD), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n▁abé.,1<>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_equals_the_library(model, library, text):
    ids = model.encode([text])[0].tolist()
    assert ids == library.encode(text, add_eos=True)
    assert model.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_any_ids_decode_as_the_library_does(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_a_wrong_merge_is_noticed(library):
    with open(PATH, "rb") as file:
        broken = pieces.PieceModel(file.read())
    del broken.scores["▁the"]
    with pytest.raises(ValueError, match="the library encodes"):
        broken.encode(["by the sea"])


def test_named_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        mine = got[r.doc_id]
        assert (mine.n_tokens, mine.ids_sha256, mine.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_nulls_repeats_clashing_names_and_few_remembered_parts(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_PARTS", 2)
    rows = [(1, "one two one three", 5), (1, "one two one three", 5), (None, None, None), (2, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = pieces.encode_decode(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted((r.doc_id or 0, list(r.ids), r.n_tokens, r.decoded) for r in out.collect())
    want = library.encode("one two one three", add_eos=True)
    assert got == [(0, [2], 1, ""), (1, want, len(want), rows[0][1]), (1, want, len(want), rows[0][1]), (2, [2], 1, "")]
    assert pieces.encode_decode(docs.limit(0), PATH).count() == 0
