import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from retinue.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["blockhead", "dimwit", "numpty", "pillock"]


def plain_kernel(s, t):
    """Sum over all pairs of equal subsequences of three letters, by the letters they span."""

    def subsequences(word):
        found = [(at, word[at[0]] + word[at[1]] + word[at[2]], at[-1] - at[0] + 1) for at in itertools.combinations(range(len(word)), 3)]
        return [(letters, toxicity.DECAY**span) for _, letters, span in found if span <= toxicity.SPAN]

    left, right = subsequences(s), subsequences(t)
    norms = [sum(w * w for _, w in side) ** 0.5 for side in (left, right)]
    return sum(v * w for a, v in left for b, w in right if a == b) / (norms[0] * norms[1]) if left and right else 0.0


def test_kernel_equals_all_pairs_of_subsequences():
    words = ["^abc", "^abac", "^xaxbxc", "^a", "^éèéé", "^aaaa", "^cba", "^a-very-long-word-cbabc", "日本語日本"]
    landmarks = [w for w in words if len(w) > 3 and w != "^cba"]
    found = toxicity.Basis.of(landmarks).kernel(words)
    want = np.array([[plain_kernel(s, t) for t in landmarks] for s in words])
    assert np.allclose(found, want, rtol=1e-5)
    assert toxicity.Basis.of([]).kernel(words).shape == (len(words), 0)


def test_a_subsequence_costs_as_much_as_landmarks_that_have_it():
    rng = random.Random(7)
    landmarks = ["^" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(64)]
    basis = toxicity.Basis.of(landmarks)
    words = landmarks * 30
    basis.kernel(words[:64])
    tracemalloc.start()
    found = basis.kernel(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, np.tile(basis.kernel(landmarks), (30, 1)), atol=1e-6)
    # Weights of all 64 landmarks for each of the 2^17 subsequences of a step would be 33 MB.
    assert peak < 24e6


def test_spelled_words_between_any_white_space():
    for space in (" ", "\n", "\t", " \n ", "\n\n", "\u2003", "\x1c"):
        assert toxicity.tokens(space.join("you dim idiot")) == ["youdimidiot"]
        assert toxicity.tokens(f"a,{space}b{space}c-d, e f") == ["abc-d,", "e", "f"]
        assert "bcd" in toxicity.tokens(f"aa{space}b.{space}c{space}d")
    assert toxicity.tokens("it is so . a . b no") == ["it", "is", "so", ".", "a", ".", "b", "no"]


def test_evidence_of_a_batch_is_that_of_its_texts(monkeypatch):
    basis = toxicity.Basis.of(["^" + word for word in INSULTS])
    machine = toxicity.Machine(basis, np.array([1.0, 2.0, 1.5, 1.2]), -0.8)
    texts = [text for _, text, _ in corpus(60)]
    texts += [None, "", "…!?", "dimwit", "a\nb", "so. " * 70 + "so " * 200 + "numpty " * 150, "x" * 500 + "pillock", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def plain(text):
        words = toxicity.tokens(text)
        bad = [any(machine.values([w])[0] + machine.offset > 0 for w in toxicity.windows(word)) for word in words]
        sentences, size = [False], 0
        for word, toxic in zip(words, bad):
            if size == toxicity.SENTENCE:
                sentences, size = [*sentences, False], 0
            sentences[-1], size = sentences[-1] or toxic, size + 1
            if toxicity.ends_sentence(word):
                sentences, size = [*sentences, False], 0
        sentences = sentences if size else sentences[:-1]
        different = len({word for word, toxic in zip(words, bad) if toxic})
        share = sum(sentences) / len(sentences) if words else 0
        return [share, np.log1p(sum(bad)), np.log1p(different), sum(bad) / (len(words) + 20)]

    want = np.array([plain(text) for text in texts])
    assert (want[:, 1] > 0).sum() >= 12
    assert np.allclose(toxicity._evidence(batch, toxicity._Values(machine)), want, rtol=1e-12)
    # Small memories, groups and steps change nothing.
    for name, value in (("REMEMBERED", 40), ("LETTERS", 500), ("WORDS", 7), ("CELLS", 100)):
        monkeypatch.setattr(toxicity, name, value)
        known = toxicity._Values(machine)
        assert all(np.allclose(toxicity._evidence(batch, known), want, rtol=1e-12) for _ in range(2))


def test_tokens_and_sentences():
    assert toxicity.tokens("You I.D.I.O.T!\nOK") == ["you", "i.d.i.o.t!", ".", "ok"]
    assert toxicity.tokens("an i d i o t here") == ["an", "idiot", "here"]
    assert toxicity.tokens(None) == []
    assert toxicity.windows("I*d-i".lower()) == ["^idi"] and toxicity.windows("--") == []
    assert all(len(w) <= toxicity.WINDOW for w in toxicity.windows("x" * 1000))
    starts = toxicity.sentence_starts(np.array([False, True, False] + [False] * 130))
    assert starts.tolist() == [0, 2, 66, 130]


def corpus(n=1600, seed=2):
    """Made-up sentences; a fifth of the documents has insults, some of them with letters inserted."""
    rng = random.Random(seed)
    parts = ["lo", "ra", "ti", "men", "so", "ve", "ka", "nu", "bel", "or"]
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        if toxic:
            for at in rng.sample(range(len(words)), max(2, len(words) // 20)):
                words[at] = rng.choice(INSULTS)
        text = " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)
        rows.append((k, text, int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs.withColumns({"score": F.lit("clash"), "toxic": F.lit(9)}), labels


def test_held_out_accuracy_and_altered_insults(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in found if found[i].held_out} == set(held)
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())

    # Insults as never seen in training: letters and signs inserted.
    clean = [t for i, t, y in rows if not y][:40]
    altered = ["blo-ckh-ead", "dim*wit", "nuumpty", "p.i.l.l.o.c.k", "dimmwit", "n u m p t y", "BLOCKHEAAD!"]
    changed = [" ".join(f"{w} {altered[n // 6 % 7]}" if n % 6 == 0 else w for n, w in enumerate(t.split())) for t in clean]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(clean + changed)], "doc_id long, text string")
    caught = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).collect()}
    assert sum(caught[n] for n in range(40)) <= 2
    assert sum(caught[n + 40] for n in range(40)) >= 36


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels).machine.basis.landmarks == toxicity.train(docs, flipped).machine.basis.landmarks
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, toxicity.train(docs, use)).collect()) for use in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    rows = corpus(300)
    docs, labels = frames(spark, rows)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 0, 1), (5, 0, 1)], labels.schema))
    model = toxicity.train(docs, labels)
    long = "dimwit, you dimwit. " * 20_000 + "x" * 100_000
    odd = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, " \n\t"), (4, long), (4, long), (5, "…!?")], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.held_out, r.predicted) for r in toxicity.toxicity(odd, model).collect()))
    assert [f[0] for f in found] == [0, 1, 2, 3, 4, 4, 5] and not found[0][1]
    assert [f[2] for f in found] == [0, 0, 0, 0, 1, 1, 0]
    assert toxicity.toxicity(odd.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, none).collect())
    one = toxicity.train(docs, labels.filter("toxic = 1"))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, one).collect())
