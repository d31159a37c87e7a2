"""Words, their hashes and Arrow batches, as the Python side of several operators needs them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from xxhash import xxh64_intdigest

#: Rows of one Arrow batch: long texts in all of them still fit a Python worker.
BATCH_ROWS = 512
#: Words a worker remembers before it begins anew; results do not depend on it.
REMEMBERED = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers in batches of at most ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; split at ASCII white space. Null has none."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * _END
    return values ^ (values >> np.uint64(29))


def fold(columns) -> np.ndarray:
    """One 64-bit hash for each row of equally long hash columns, depending on their order and number."""
    total = None
    for n, column in enumerate(columns):
        total = column + np.uint64(n + 1) if total is None else total * _MIX + column + np.uint64(n + 1)
    return finish(total)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all windows of ``width`` words; of fewer words, the whole sequence as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(n, width)
    windows = n - take + 1
    return np.unique(fold([hashes[i : i + windows] for i in range(take)]))
