import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from retinue.llm import boosting, quality
from retinue.llm import deleted_interpolation as lm
from retinue.llm.words import WordHashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, values):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in values], SCHEMA).repartition(4)


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def is_held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_scores(values):
    """Counts, the unigram score, and the estimates of the interpolated model."""
    train = [tokens_of(t) for i, t in values if not is_held(i)]
    words = collections.Counter(w for text in train for w in text)
    pairs = collections.Counter(p for text in train for p in zip([None, *text], text))
    total, distinct = sum(words.values()), len(words)
    return words, pairs, total, distinct


def sample(n=60):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    values = [(i, " ".join(rng.choices(vocabulary[: 5 + i % 36], k=rng.randrange(0, 50)))) for i in range(n)]
    return values + [(None, "w1 W2 unseen"), (1000, None), (1001, ""), (1002, "É é w1"), (3, "w1 w2")]


def test_scores_against_plain_counts(spark):
    values = sample()
    rows = lm.scores(docs_of(spark, values), block_words=200).collect()
    words, _, total, distinct = plain_scores(values)
    want = sorted(
        (i or -1, is_held(i), len(tokens_of(t)), sum(words[w] > 0 for w in tokens_of(t)), total, round(sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens_of(t)), 6))
        for i, t in values
    )
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want


def test_scores_do_not_depend_on_the_blocks(spark):
    values = sample()
    runs = [lm.scores(docs_of(spark, values), block_words=n).collect() for n in (50, 100_000)]
    keyed = [sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in rows) for rows in runs]
    assert keyed[0] == keyed[1]


def test_weights_come_from_training_texts_alone(spark):
    values = sample()
    words, pairs, total, distinct = plain_scores(values)
    given = []
    for text in (tokens_of(t) for i, t in values if not is_held(i)):
        for p in zip([None, *text], text):
            n = words[p[0]] - 1
            alone = (words[p[1]] - 1) / (total - 1)
            given.append((min(int(math.log2(n)) + 1, lm.BUCKETS) if n else 0, (pairs[p] - 1) / n if n else alone, alone))
    weights = np.full((lm.BUCKETS + 1, 3), 1 / 3)
    bucket, mixed = np.array([g[0] for g in given]), np.array([[*g[1:], 1 / (distinct + 1)] for g in given])
    for _ in range(lm.ROUNDS):
        shares = weights[bucket] * mixed
        shares /= shares.sum(axis=1, keepdims=True)
        sums = np.stack([np.bincount(bucket, shares[:, k], lm.BUCKETS + 1) for k in range(3)], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)

    def plain(text):
        score = 0
        for p in zip([None, *text], text):
            n, alone = words[p[0]], words[p[1]] / total
            parts = [pairs[p] / n if n else alone, alone, 1 / (distinct + 1)]
            score += math.log10(np.dot(weights[min(int(math.log2(n)) + 1, lm.BUCKETS) if n else 0], parts))
        return score

    rows = lm.scores(docs_of(spark, values)).collect()
    want = sorted((i or -1, len(tokens_of(t)), plain(tokens_of(t))) for i, t in values)
    for got, (i, n, score) in zip(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in rows), want):
        assert got[:2] == (i, n) and abs(got[2] - score) < 0.02 * max(1, n)

    changed = [(i, "w1 other words w2 w2 " * 9 if is_held(i) else t) for i, t in values]
    again = lm.scores(docs_of(spark, changed)).collect()
    keyed = [sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in found if not r.held_out) for found in (rows, again)]
    assert len(keyed[0]) > 40 and keyed[0] == keyed[1]


def test_weights_follow_the_likelihood():
    import pandas as pd

    cells = pd.DataFrame({"bucket": [3, 3], "n": [900, 100], "pair": [900 * 0.5, 0.0], "word": [900 * 0.01, 100 * 0.01]})
    weights = lm.learn_weights(cells, 1e-4)
    assert weights[3, 0] > 0.8 and abs(weights.sum(axis=1) - 1).max() < 1e-9 and (weights > 0).all()

    def loglik(w):
        return 900 * math.log(w[0] * 0.5 + w[1] * 0.01 + w[2] * 1e-4) + 100 * math.log(w[1] * 0.01 + w[2] * 1e-4)

    best = max((loglik((a, b, 1 - a - b)) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 0.999))
    assert loglik(weights[3]) > best - 2


def test_model_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(2)
    after = {k: [rng.randrange(200) for _ in range(3)] for k in range(200)}

    def text():
        word, out = rng.randrange(200), []
        for _ in range(80):
            word = rng.choice(after[word])
            out.append(f"w{word}")
        return " ".join(out)

    rows = [r for r in lm.scores(docs_of(spark, [(i, text()) for i in range(300)])).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)


def test_language_model_of_nothing(spark):
    docs = docs_of(spark, [(1, "a")]).withColumn("words", F.lit(1))
    assert lm.scores(docs.limit(0)).count() == 0
    (only,) = lm.scores(docs_of(spark, [(None, "a b")])).collect()
    assert only.held_out and only.train_tokens == 0 and only.base_score == 0.0 and math.isfinite(only.score)


def test_trees_learn_and_keep_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=3000) > 0).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], [1, 0, -1])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    grid = np.linspace(-4, 4, 200)
    for row in x[:50]:
        for feature, way in ((0, 1), (2, -1)):
            line = np.tile(row, (200, 1))
            line[:, feature] = grid
            assert (way * np.diff(trees.margin(line)) >= -1e-12).all()


def test_trees_without_both_labels():
    trees = boosting.fit(np.zeros((5, 2)), np.zeros(5), [0, 0])
    assert len(trees.roots) == 0 and trees.probability(np.ones((2, 2))).max() < 0.5
    assert boosting.calibrated_cut(np.array([]), np.array([]), 0.9) == 2.0
    assert boosting.calibrated_cut(np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 0]), 0.6) == 0.8


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)], n < 10 or 100 * len(covered) > 20 * n


def test_base_counts():
    rng = random.Random(4)
    parts = ["a", "b", "É#", "|", "\n", " ", "\t", "a b c d e", "x" * 40, "日本", "\x0b", "<>&"]
    known = WordHashes()
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randrange(40))) if rng.random() < 0.5 else "".join(rng.choices(parts, k=rng.randrange(40)))
        base, features = quality.statistics(text.encode(), known)
        want, failed = plain_base(text)
        assert base == want and np.isfinite(features).all()
        assert bool(quality.base_failed(np.array([base]))[0]) == failed


def corpus():
    rng = random.Random(9)
    good = [" ".join(rng.choices("the of and to house river stone walks under bright morning".split(), k=60)) + f" {k}." for k in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices("win cash now click here free offer".split(), k=40)) + f" {k}" for k in range(150)]
    return list(enumerate(good + bad))


def test_quality_model_on_held_out_documents(spark):
    values = corpus()
    docs = docs_of(spark, values)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in values if i % 2], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.quality_rules(docs.withColumn("kept", F.lit("x")), model).collect()}
    unseen = [i for i, _ in values if i % 2 == 0 and not rows[i].base_failed]
    assert np.mean([rows[i].kept == (i < 150) for i in unseen]) > 0.97
    kept = quality.quality_filter(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_quality_odd_rows(spark):
    docs = docs_of(spark, [(None, "a " * 12), (1, None), (2, ""), (2, ""), (3, "one two three four five six seven eight nine ten eleven twelve " * 1)])
    for labels in ([], [(3, 1)], [(None, 0), (3, None)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = quality.quality_rules(docs, model).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in rows) == [(-1, 12, False), (1, 0, False), (2, 0, False), (2, 0, False), (3, 12, True)]
    assert quality.quality_rules(docs.limit(0), model).count() == 0


def test_counts_beyond_32_bits():
    """Two blocks with three thousand million of one word each, and smaller counts beside it."""
    import pandas as pd

    hashes = np.array([5, 2**40, 2**63 + 11], np.uint64)
    counts = [np.array([3_000_000_000, 7, 0xFFFFFFFF], np.uint32), np.array([3_000_000_000, 1, 0], np.uint32)]
    rows = [(0, 1, n, False, lm._planes(hashes), c.tobytes()) for n, c in enumerate(counts)]
    rows.append((0, 1, 2, True, lm._planes(hashes[1:]), b""))
    found = lm._answer(pd.DataFrame(rows, columns=["range", "kind", "block", "held", "hashes", "counts"]))
    totals = [lm._unfolded(t, w).tolist() for t, w in zip(found["totals"], found["wide"])]
    assert totals == [[6_000_000_000, 8, 0xFFFFFFFF]] * 2 + [[8, 0xFFFFFFFF]]
    assert found["tokens"].sum() == 6_000_000_000 + 8 + 0xFFFFFFFF and found["distinct"].sum() == 3


def test_ranges_rise_with_the_hashes():
    hashes = np.sort(np.random.default_rng(4).integers(0, 2**64, 5000, dtype=np.uint64))
    found = lm._range_of(np.r_[hashes, np.uint64(2**64 - 1)], 37)
    assert (np.diff(found) >= 0).all() and found.min() == 0 and found.max() == 36
