import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from retinue.llm import resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs, target):
    """The contract, one document after another."""

    def features(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = [0] * 10000, [0] * 10000
    for texts, counts in (([d[1] for d in docs], s), (target, t)):
        for text in texts:
            for bucket in features(text)[1]:
                counts[bucket] += 1
    size, aim = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log((b + 1) * size / ((a + 1) * aim))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, row in enumerate(able[: 25 * len(able) // 100]):
        row[5] = n + 1
    return sorted(map(tuple, rows), key=repr)


def corpus(n=400):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "ÉTÉ", "x" * 90, "日本語", "9to5"]
    docs = [(k, rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !!"), (n + 3, "Word " * 30_000)]
    target = [" ".join(rng.choices(vocabulary[:20], k=40)) for _ in range(30)] + [None, ""]
    return docs, target


def frames(spark, docs, target):
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA).repartition(5)
    clash = {name: F.lit("clash") for name in ("score", "weight", "rank", "_part", "n_words")}
    return frame.withColumns(clash), spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1))


def rows_of(found):
    return sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()], key=repr)


def test_equal_to_plain(spark):
    docs, target = corpus()
    assert rows_of(resampling.resample(*frames(spark, docs, target))) == plain(docs, target)


def test_null_ids_and_repeated_rows(spark):
    """Rows that repeat an id at the cutoff: the number drawn holds, whichever of them it is."""
    docs, target = corpus(20)
    text = "a b c d e f g h i j k l m n o p q r s t u"
    docs += [(7_000, text)] * 50 + [(None, text)] * 3
    found = rows_of(resampling.resample(*frames(spark, docs, target)))
    want = plain(docs, target)
    strip = lambda rows: sorted((r[:5] for r in rows), key=repr)
    assert strip(found) == strip(want)
    assert sorted(r[5] for r in found if r[5]) == sorted(r[5] for r in want if r[5])
    assert sorted((r[5], r[4]) for r in found if r[5]) == sorted((r[5], r[4]) for r in want if r[5])


def test_bracket_widens_until_it_holds_the_cutoff(spark):
    """One score for nearly all rows, and a bracket without width: exact counts decide."""
    scores = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, F.col("id")).otherwise(F.lit(50)).cast("long").alias("score"))
    rows = sorted(((-r.score, r.doc_id) for r in scores.collect()))
    for percent in (1, 25, 50, 99, 100):
        wanted = percent * 30
        score, doc_id, number = resampling.cutoff(scores, percent, margin=0.0005)
        assert (-score, doc_id, number) == (*rows[wanted - 1], wanted)


def test_nothing_to_draw(spark):
    docs, target = frames(spark, [(1, "a b"), (2, None)], [])
    assert [r["rank"] for r in resampling.resample(docs, target).collect()] == [None, None]
    assert resampling.resample(docs.limit(0), target).count() == 0
