"""Quality rules: boosted trees over document statistics, above two fixed rules.

The trees are fitted on a bounded sample of labelled documents and travel to the
rows as flat node arrays, which score whole Arrow batches at once. The score may
only fall when a document has more symbols, repetition or capitals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retinue.llm.boosting import Trees, calibrated_cut, fit
from retinue.llm.words import WordHashes, fold, small_batches

#: Labelled documents that the trees are fitted and calibrated on, at most.
TRAINING_ROWS = 20_000
#: Share of truly bad documents that the rejected ones must reach in calibration.
PRECISION = 0.98
#: A document is never rejected at a lower score than this.
LEAST_CUT = 0.5
#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic -> direction in which the score may move as it grows (0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "upper": -1,
    "exclaims_per_word": -1,
    "digits": 0,
    "distinct_words": 0,
    "top_word": -1,
    "alike_neighbours": -1,
    "words_per_line": 0,
    "stops_per_word": 0,
}


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SPACE, _SYMBOL = _is(b" \t\n\x0b\x0c\r"), _is(SYMBOLS)
_UPPER, _DIGIT = _is(bytes(range(65, 91))), _is(bytes(range(48, 58)))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of five words that occur twice or more, the first included; each counts once."""
    windows = len(hashes) - WINDOW + 1
    if windows < 2:
        return 0
    _, same, count = np.unique(fold([hashes[i : i + windows] for i in range(WINDOW)]), return_inverse=True, return_counts=True)
    starts = count[same] > 1
    covered = np.zeros(len(hashes), bool)
    for i in range(WINDOW):
        covered[i : i + windows] |= starts
    return int(covered.sum())


def statistics(text: bytes | None, known: WordHashes) -> tuple[list[int], list[float]]:
    """The counts of ``BASE`` and the values of ``FEATURES`` of one UTF-8 text; null counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(chars[0x80:0xC0].sum())
    word_chars = points - int(chars[_SPACE].sum())
    symbols = int(chars[_SYMBOL].sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    hashes = known.of(words)
    repeated = repeated_words(hashes)
    _, counts = np.unique(hashes, return_counts=True)
    per_word, per_char = max(n, 1), max(word_chars, 1)
    features = [
        np.log1p(n),
        word_chars / per_word,
        symbols / per_word,
        dup_lines / max(len(lines), 1),
        repeated / per_word,
        chars[_UPPER].sum() / per_char,
        chars[33] / per_word,
        chars[_DIGIT].sum() / per_char,
        len(counts) / per_word,
        (counts.max() if n else 0) / per_word,
        (hashes[1:] == hashes[:-1]).sum() / per_word if n > 1 else 0.0,
        n / max(len(lines), 1),
        chars[46] / per_word,
    ]
    return [n, word_chars, symbols, dup_lines, repeated], features


def base_failed(base: np.ndarray) -> np.ndarray:
    """The fixed rules of the contract: too few words, or over a fifth of them repeated."""
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


@dataclass(frozen=True)
class Model:
    """Trees for the probability of a bad document, and the score from which one is rejected."""

    trees: Trees
    cut: float

    def rejects(self, features: np.ndarray) -> np.ndarray:
        return self.trees.probability(features) >= self.cut


def _measure(batch: pa.RecordBatch, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(text, known) for text in batch.column("text").cast(pa.binary()).to_pylist()]
    base = np.array([row[0] for row in rows], np.int64).reshape(len(rows), len(BASE))
    return base, np.array([row[1] for row in rows], np.float64).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, spread over all of them by a hash of ``doc_id``.

    ``labels`` is ``<doc_id, quality>`` with 1 for good. Half of the sample
    fits the trees, the other half calibrates the score of rejection. Without
    usable labels nothing is rejected beyond the fixed rules.
    """
    small_batches(docs.sparkSession)
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def measure(batches):
        known = WordHashes()
        for batch in batches:
            _, features = _measure(batch, known)
            values = pa.ListArray.from_arrays(
                np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES), pa.array(features.ravel())
            )
            bad = pa.array([int(q == 0) for q in batch.column("quality").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bad, values], ["doc_id", "bad", "features"])

    measured = texts.mapInArrow(measure, "doc_id long, bad int, features array<double>")
    # Rows that repeat a doc_id could exceed the bound, so it is kept here too.
    found = measured.orderBy("doc_id", "features").limit(rows).toPandas()
    x = np.array(found["features"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    y = found["bad"].to_numpy(np.float64)
    held_out = np.arange(len(y)) % 2 == 1
    # Bad is what grows where the score of a good document falls.
    trees = fit(x[~held_out], y[~held_out], [-way for way in FEATURES.values()])
    return Model(trees, max(LEAST_CUT, calibrated_cut(trees.probability(x[held_out]), y[held_out], PRECISION)))


def quality_rules(docs: DataFrame, model: Model) -> DataFrame:
    """``<doc_id, BASE counts, base_failed, kept, bad_score>``, one row for every row of ``docs``.

    ``kept`` is false where ``base_failed``, else the verdict of ``model``.
    Only ``doc_id`` and ``text`` are read. Null text counts as empty and fails
    the fixed rules; null ids and repeated rows are rows like others; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def judge(batches):
        known = WordHashes()
        for batch in batches:
            base, features = _measure(batch, known)
            failed = base_failed(base)
            score = model.trees.probability(features)
            kept = ~failed & ~(score >= model.cut)
            columns = [batch.column("doc_id"), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "bad_score"])

    counts = ", ".join(f"{name} long" for name in BASE)
    schema = f"doc_id long, {counts}, base_failed boolean, kept boolean, bad_score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns."""
    small_batches(docs.sparkSession)

    def keep(batches):
        known = WordHashes()
        for batch in batches:
            base, features = _measure(batch, known)
            yield batch.filter(pa.array(~base_failed(base) & ~model.rejects(features)))

    return docs.mapInArrow(keep, docs.schema)
