import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retinue.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return packing.encoder_of(file.read())


def test_ids_are_those_of_the_library(encoder, library):
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", " \n", "é", "日本", "it's", "1234", "\t", " ", " ", "\x1c", ".", "...", "<|endoftext|>", "a" * 300, "🙂"]
    texts = ["", " ", "a ", " a", "\n"] + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(800)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*library(text), packing.END_ID], repr(text)


def test_added_tokens_have_the_ids_of_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    added = packing.added_tokens(path)
    assert added == (("<|endoftext|>", 50256),)
    with open(RANKS, "rb") as file:
        own = packing.Encoder(file.read(), added)
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "é", "it's", "12", ".", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>"] + ["".join(rng.choices(parts, k=rng.randrange(1, 20))) for _ in range(500)]
    want = [[*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID] for text in texts]
    assert want[0] == [64, 220, 50256, 275, packing.END_ID]
    assert [ids.tolist() for ids in own.encode(texts)] == want
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts[:50])], "doc_id long, text string")
    stage = corpus_pipeline.pack_windows(spark, docs, "").collect()
    for i, ids in enumerate(want[:50]):
        pieces = sorted((r.start, bytes(r.ids)) for r in stage if r.doc_id == i)
        assert b"".join(piece for _, piece in pieces) == np.array(ids, "<u4").tobytes()


def best_cost(places, penalties, window):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places) - 1):
        cost[j] = min(cost[i] + window - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= window and cost[i] is not None)
    return min(cost[i] for i in range(len(places) - 1) if places[-1] - places[i] <= window)


def test_cuts_have_the_least_cost():
    rng = random.Random(5)
    for _ in range(200):
        window = rng.choice([8, 20])
        places = np.cumsum([0] + [rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 40))]).tolist()
        penalties = [rng.choice([0, 2, 8]) for _ in places]
        cuts = packing.best_cuts(places, penalties, window)
        at = dict(zip(places, penalties))
        cost = sum(window - (b - a) + at[b] for a, b in zip([0, *cuts], cuts[:-1]))
        assert cost == best_cost(places, penalties, window) and max(np.diff([0, *cuts])) <= window


def check_pieces(rows, texts, library):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for doc_id, text in texts:
        ids = [*library(text or ""), packing.END_ID]
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and bytes(r.ids) == own and r.crc == zlib.crc32(own)
            at += r.length
        assert at == len(ids)
    lengths = [sum(n for _, n in parts) for parts in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in lengths), sum(lengths)


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, RANKS).withColumn("crc", F.crc32("ids")).collect()
    padding, tokens = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert padding < 0.01 * tokens


def test_odd_rows_and_blocks(spark, library, monkeypatch):
    texts = [(None, "a b. c"), (1, None), (2, ""), (3, "word " * 9000), (4, "x" * 30_000), (5, "One. Two. " * 700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS start").coalesce(1)
    rows = packing.pack_documents(docs, RANKS).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(rows, texts, library)
    twice = packing.pack_documents(docs.filter("doc_id = 2").union(docs.filter("doc_id = 2")), RANKS).collect()
    assert [(r.start, r.length, r.doc_tokens) for r in twice] == [(0, 1, 1)] * 2
    assert packing.pack_documents(docs.limit(0), RANKS).count() == 0


def test_small_blocks_go_on(encoder):
    """Windows run on from one block into the next."""
    packer, rows = packing.Packer(encoder, 7), []
    docs = [encoder.encode([f"Sentence {k}. " * (k % 50)])[0] for k in range(120)]
    for k, ids in enumerate(docs):
        packer.add(k, ids)
        if packer.tokens >= 5000:
            rows += packer.pack(False)
    rows += packer.pack(True)
    joined = {}
    for doc_id, start, length, data, total, _, _ in rows:
        assert start == len(joined.get(doc_id, b"")) // 4 and total == len(docs[doc_id])
        joined[doc_id] = joined.get(doc_id, b"") + data
    assert all(joined[k] == ids.tobytes() for k, ids in enumerate(docs))
    assert [r[5] for r in rows] == sorted(r[5] for r in rows)


def test_powers():
    assert packing.powers(1500) == [1024, 1280, 1408, 1472, 1488, 1496, 1500] and packing.powers(0) == []
