import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retinue.llm import exact_dedup, near_dedup
from retinue.llm.components import components
from retinue.llm.spread import spread_join, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, values):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in values], SCHEMA).repartition(5)


def plain_exact(values):
    texts = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in values]
    out = []
    for i, t, n in texts:
        group = [(len(u), -j) for j, u, m in texts if m == n]
        keep = -max(group)[1]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


EXACT = [(5, "a b"), (3, "ab"), (9, "a\t b\n"), (1, None), (2, ""), (4, " \r\x0b\x0c"), (7, "É x"), (8, "éx"), (6, "a b"), (10, "x" * 50_000), (11, "x" * 50_000), (11, "x" * 50_000)]


@pytest.mark.parametrize("bits", [62, 1])
@pytest.mark.parametrize("capacity", [4096, 1])
def test_exact_groups(spark, bits, capacity):
    """With one bit of hash, nearly all texts collide and are told apart by their bytes."""
    found = exact_dedup.exact_duplicates(docs_of(spark, EXACT), capacity, bits)
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()]
    assert sorted(rows) == plain_exact(EXACT)
    if bits == 1:
        assert found.agg(F.max("chain")).first()[0] > 0


def test_directory_doubles_where_buckets_are_full(spark):
    bits = 10
    keys = spark.range(512).select(F.col("id").alias("code")).union(spark.createDataFrame([(1023,)], "code long"))
    slots, used = exact_dedup.directory(keys, 513, 16, bits)
    buckets = {(r.bucket, r.depth) for r in slots.collect()}
    assert used >= 6 and (2**(used - 1), 1) in buckets
    sizes = keys.withColumn("slot", F.shiftright("code", bits - used)).join(slots, "slot").groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 16


def test_exact_odd_rows(spark):
    docs = docs_of(spark, [(None, "a"), (None, "a b"), (3, "a")])
    rows = exact_dedup.exact_duplicates(docs.withColumn("code", F.lit("x")).withColumn("digest", F.lit(1))).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 1, True), (-1, 3, 2, False), (3, 3, 2, True)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_native_operators_have_no_python(spark, monkeypatch):
    """All tables that exact duplicates are made of, and the last step."""
    plans = []
    write = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda frame, label: plans.append(frame) or write(frame, label))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    plans.append(exact_dedup.exact_duplicates(docs))
    assert len(plans) >= 4
    assert not any(re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString()) for frame in plans)


def plain_sets(values):
    sets = {}
    for i, text in values:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        if words:
            sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    return sets


def plain_near(values):
    sets = plain_sets(values)
    label = {i: i for i, _ in values}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return sorted((i, len(sets.get(i, ())), label[i], label[i] == i) for i, _ in values)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        action = rng.random()
        if action < 0.6:
            words[at] = rng.choice(words) + str(rng.randrange(3))
        elif action < 0.8:
            del words[at]
        else:
            words.insert(at, f"new{rng.randrange(5)}")
    return " ".join(words)


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_of_edited_copies(spark, seed):
    """Groups whose members are partly linked over others only, and some not at all."""
    rng = random.Random(seed)
    values, common = [], [f"c{k}" for k in range(40)]
    for group in range(3):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([20, 60, 120]))] + common * (group == 2)
        chain = base
        for _ in range(60):
            source = chain if rng.random() < 0.3 else base
            text = edited(rng, source, rng.randrange(1, 2 + len(base) // 12))
            values.append((len(values) * 7 % 1009, text))
            chain = text.split()
    values += [(2000 + k, edited(rng, common, 3)) for k in range(20)]
    rows = near_dedup.near_duplicates(docs_of(spark, values)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == plain_near(values)


@pytest.mark.parametrize("words, edits, with_original", [(40, 1, False), (60, 4, True)])
def test_compared_pairs_grow_with_the_copies(spark, monkeypatch, words, edits, with_original):
    """Edited copies of one text: twice as many copies take about twice as many comparisons, not four times."""
    seen = []
    write = near_dedup.materialise

    def counting(frame, label):
        found = write(frame, label)
        if label in ("near-pairs", "near-fold-pairs", "near-mixed"):
            seen.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "materialise", counting)
    compared = []
    for copies in (1250, 2500) if edits == 1 else (500, 1000):
        rng = random.Random(3)
        base, texts = [f"w{k}" for k in range(words)], []
        for _ in range(copies):
            own = list(base)
            for at in rng.sample(range(words), rng.randint(1, edits)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
        values = list(enumerate(texts)) + [(copies, " ".join(base))] * with_original
        seen.clear()
        rows = near_dedup.near_duplicates(docs_of(spark, values)).collect()
        compared.append(sum(seen))
        if edits == 1 and copies == 1250:
            assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == plain_near(values)
    assert compared[0] < 40 * copies and compared[1] < 2.8 * compared[0]


def test_near_repeated_ids(spark):
    """Texts under one id are one document: its links join what either text is linked with."""
    x, y = "a b c d e f g", "p q r s t u v"
    values = [(3, x), (5, x), (5, y), (7, y), (8, y + " other"), (9, "z")]
    rows = near_dedup.near_duplicates(docs_of(spark, values)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 3, False), (9, 9, True)]


def test_near_short_and_empty(spark):
    values = [(4, "A b"), (2, "a B"), (3, "b a"), (5, ""), (6, None), (7, " \n"), (8, "É"), (9, "é"), (10, "a b c d e"), (11, "a b c d e f " * 5000)]
    rows = near_dedup.near_duplicates(docs_of(spark, values)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == plain_near(values)


def test_near_odd_rows(spark):
    docs = docs_of(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C")]).withColumn("node", F.lit("x")).withColumn("mark", F.lit("y"))
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_tell_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.75, 0.9):
        n, far = 400, 0
        shared = int(n * 2 * similarity / (1 + similarity))
        for _ in range(30):
            values = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            pair = [near_dedup.odd_sketch(near_dedup.samples(part)) for part in (values[:n], np.r_[values[n:], values[:shared]])]
            differ = int(np.bitwise_count((pair[0] ^ pair[1]).view(np.uint64)).sum())
            far += differ > near_dedup.most_different_bits(near_dedup.RULED_OUT)
            assert differ <= near_dedup.most_different_bits(similarity - 0.2)
        assert far == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 900)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {labels[k] for k in range(100, 161)} == {100} and {labels[k] for k in range(500, 900)} == {500}


def test_hot_keys_are_split(spark):
    many = spark.range(20_000).select((F.col("id") * F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    one = spark.range(13).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = spread_join(many, one, "k", ["id"])
    assert got.groupBy("k").count().orderBy("k").collect() == many.filter("k < 13").groupBy("k").count().orderBy("k").collect()
    assert got.filter("v <> k * 10").isEmpty() and spread_join(many, one, "k", ["id"], "left").count() == 20_000


def test_without_keeps_nulls(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (2,)], "doc_id long")
    gone = spark.createDataFrame([(2,)], "doc_id long")
    assert sorted(r.doc_id or -1 for r in without(rows, gone, "doc_id").collect()) == [-1, 1]
