import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from retinue.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return pieces.pieces_of(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ALPHABET = list("aeionrstlhdTAE ..\n\t<>0x_-é日本ß½▁\x00") + ["the", "ing", "  ", "    ", "tion", "straße", "日本語", "🙂"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_like_the_library(parts):
    own_, library_ = pieces.pieces_of(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "".join(parts)
    ids = library_.encode(text)
    found = own_.encode([text])[0]
    assert found.tolist() == ids
    assert own_.decode(found) == library_.decode(ids)


def test_given_documents(own, library, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = library.encode(texts, num_threads=1)
    assert [ids.tolist() for ids in own.encode(texts)] == want
    assert [own.decode(ids) for ids in own.encode(texts)] == [library.decode(ids) for ids in want]


def test_words_go_back(own):
    """Somewhere the longest first piece is wrong, so a position has to fail."""
    text = "▁" + "ththerandinghatheinghterenstheer" * 3
    assert own.backtrack(text) == own.merge(text)


def test_bytes_that_are_no_text(own, library):
    for ids in ([own.byte[0xE3], own.byte[0x81]], [own.byte[0xFF], 264], [1, 264, 2]):
        import numpy as np

        assert own.decode(np.array(ids, np.int32)).lstrip() == library.decode(ids)


def test_long_words_and_runs(own, library):
    for text in ("aé" * 20_000, " " * 5_000 + "x", "日" * 5_000):
        assert own.encode([text])[0].tolist() == library.encode(text)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, "")], "doc_id long, text string").selectExpr("*", "text AS ids", "1 AS decoded")
    rows = pieces.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id or -1, len(r.ids), r.decoded) for r in rows) == [(-1, 2, "a b"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert pieces.encode_decode(docs.limit(0), PATH).count() == 0
