"""Importance resampling towards a target: documents drawn by bucketed n-gram weights and Gumbel noise.

Words and pairs of words fall into a fixed number of buckets by their CRC32. Two
arrays of bucket counts, of the corpus and of the target, give one array of
gains, which scores every document in one pass. The highest scores are drawn
without sorting the corpus: a quantile sketch brackets the cutoff, exact counts
outside the bracket validate it (or widen it), and only the bracket is sorted.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retinue.llm.words import REMEMBERED, small_batches
from retinue.session import materialise

BUCKETS = 10_000
#: Documents with fewer words are scored, but never drawn.
LEAST_WORDS = 20
#: Hundredths of the documents with enough words that are drawn.
PERCENT = 25
SEED = 7
#: Half the width of the first bracket, as a share of the documents.
MARGIN = 0.01
#: Size parameter of the quantile sketch: its rank error is about 1.3 hundredths at 200 and falls with the size.
SKETCH_K = 800

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@cache
def _shift(length: int) -> np.ndarray:
    """Four tables of 256 entries: what ``length`` more bytes make of each byte of a CRC32."""
    # The checksum is linear: that of two joined parts is the moved first one, xor the second.
    zeros = bytes(length)
    still = zlib.crc32(zeros, 0)
    table = np.zeros((4, 256), np.uint32)
    for place in range(4):
        bits = [zlib.crc32(zeros, 1 << (8 * place + bit)) ^ still for bit in range(8)]
        for bit, value in enumerate(bits):
            table[place, 1 << bit : 2 << bit] = table[place, : 1 << bit] ^ np.uint32(value)
    return table


class _Words(dict):
    """word -> its number; per number the CRC32 of the word, of the word after a space, and its length."""

    LONGEST = 64

    def __init__(self):
        super().__init__()
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.alone = np.zeros(1024, np.uint32)
        self.after = np.zeros(1024, np.uint32)
        self.length = np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.alone):
            for name in ("alone", "after", "length"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.alone[number] = zlib.crc32(word)
        self.after[number] = zlib.crc32(b" " + word)
        self.length[number] = len(word) + 1
        self[word] = number
        return number

    def features(self, words: list[bytes]) -> np.ndarray:
        """CRC32 of all words and all pairs of neighbours."""
        if len(self) >= REMEMBERED:
            self._empty()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        alone = self.alone[numbers]
        if len(words) < 2:
            return alone
        first, second, length = alone[:-1], self.after[numbers[1:]], self.length[numbers[1:]]
        pairs = np.zeros(len(first), np.uint32)
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            if size > self.LONGEST:
                pairs[at] = [zlib.crc32(b" " + words[n + 1], int(first[n])) for n in at]
                continue
            table, crc = _shift(int(size)), first[at]
            moved = table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]
            pairs[at] = moved ^ second[at]
        return np.concatenate([alone, pairs])


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case: runs of digits, letters and all beyond ASCII."""
    return _WORD.findall(text.lower()) if text else []


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all ``<text>`` fall into each bucket.

    Every task sends one row per bucket it meets; the driver gets one per bucket.
    """
    small_batches(texts.sparkSession)

    def count(batches):
        known, total = _Words(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                total += np.bincount(known.features(words_of(text)) % BUCKETS, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long")
    total = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares of every bucket in target and corpus."""
    size, aim = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    ratios = ((t + 1) * size / ((s + 1) * aim) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel variate that ``doc_id`` fixes; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``<doc_id, n_words, n_features, weight>`` of every row: the floored mean gain of its features."""
    small_batches(docs.sparkSession)

    def weigh(batches):
        known = _Words()
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                found = known.features(words)
                total = int(gain[found % BUCKETS].sum())
                rows.append((len(words), len(found), total // len(found) if len(found) else 0))
            columns = np.array(rows, np.int64).reshape(len(rows), 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    schema = "doc_id long, n_words long, n_features long, weight long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, schema)


def _order() -> list[Column]:
    """The order in which documents are drawn."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def ranked(rows: DataFrame, label: str, after: int = 0) -> DataFrame:
    """``rows`` with their ``rank`` (from ``after`` + 1) by falling score, ties to the smaller ``doc_id``.

    Ranges of the order are sorted separately, however many rows share one
    score, and numbered from the counts of the ranges before them.
    """
    spark = rows.sparkSession
    order = _order()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Within a partition the numbers of rows follow their order.
    number = F.monotonically_increasing_id()
    placed = placed.withColumn("_part", F.shiftright(number, 33)).withColumn("_place", number.bitwiseAND((1 << 33) - 1))
    placed = materialise(placed, label)
    # One row per range.
    sizes = dict(placed.groupBy("_part").count().collect())
    starts, start = [], after + 1
    for part in sorted(sizes):
        starts.append((part, start))
        start += sizes[part]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    found = placed.join(F.broadcast(offsets), "_part")
    return found.withColumn("rank", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def _bracket(able: DataFrame, n: int, wanted: int, margin: float) -> tuple[int, int, int]:
    """``(low, high, above)``: scores between which the wanted place lies, and how many scores are above ``high``.

    The sketch proposes them; exact counts decide, and widen the bracket until it holds the place.
    """
    sketch = able.agg(F.kll_sketch_agg_bigint("score", F.lit(SKETCH_K)).alias("sketch"))
    share = 1 - wanted / n
    while True:
        ends = [min(max(share + side * margin, 0.0), 1.0) for side in (-1, 1)]
        quantiles = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(end)).alias(f"q{i}") for i, end in enumerate(ends)]
        low, high = sketch.select(*quantiles).first()
        if ends[0] == 0.0:
            low = -(1 << 62)
        if ends[1] == 1.0:
            high = 1 << 62
        counts = able.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if counts["above"] < wanted <= counts["reached"]:
            return low, high, counts["above"]
        margin *= 4


def cutoff(able: DataFrame, percent: int = PERCENT, margin: float = MARGIN) -> tuple[int, int | None, int] | None:
    """``(score, doc_id, number)``: the last document drawn from ``<doc_id, score>``, and how many are drawn.

    None if none is drawn. Only the scores inside the bracket are sorted.
    """
    n = able.count()
    wanted = percent * n // 100
    if not wanted:
        return None
    low, high, above = _bracket(able, n, wanted, margin)
    inside = able.filter(F.col("score").between(low, high)).select("doc_id", "score")
    last = ranked(inside, "resample-bracket", above).filter(F.col("rank") == wanted).first()
    return last["score"], last["doc_id"], wanted


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``<doc_id, n_words, n_features, weight, score, rank>``, one row for every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: those of the highest score, ties to the smaller
    ``doc_id``. They are numbered from 1 in that order; ``rank`` is null for the
    others. ``target`` is ``<text>``; other columns are not read.

    * Null and empty texts have no features, weight 0, and are not drawn.
    * A null ``doc_id`` counts as empty text in the noise and sorts behind all ids; rows that
      repeat an id are documents of their own, drawn in any order among themselves.
    * Without target texts all gains compare with an even spread. An empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = materialise(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    last = cutoff(scored.filter(able), percent)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select("*", none)
    score, doc_id, wanted = last
    tie = F.col("score") == score
    reached = tie if doc_id is None else tie & (F.col("doc_id") <= doc_id)
    reached = able & F.coalesce((F.col("score") > score) | reached, F.lit(False))
    drawn = ranked(scored.filter(reached), "resample-drawn")
    # Rows that repeat the last id may reach beyond the number.
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*scored.columns, "rank").union(scored.filter(~reached).select("*", none))
