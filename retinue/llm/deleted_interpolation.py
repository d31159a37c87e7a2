"""Language-model scores by deleted interpolation.

The probability of a word mixes maximum-likelihood estimates: after its
predecessor, on its own, and uniform over the vocabulary. The weights depend on
how often the predecessor occurs in the training texts. Expectation maximisation
learns them from the training texts alone: every token is left out of the counts
that predict it. Texts that are held out are only scored.

Texts are taken in blocks. A block asks for the counts of its distinct words and
word pairs, not of each occurrence: the requests, packed and sorted by hash, are
dealt to count tasks by ranges of the hash, summed there over all blocks, and
the sums return to their block in the order in which they were asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retinue.llm.words import WordHashes, fold, lower_words, small_batches
from retinue.session import bucket_count, bucketed, materialise

#: Documents whose CRC-32 of the id leaves HELD_OUT modulo FOLDS are not counted.
FOLDS, HELD_OUT = 7, 2
#: Words of a block: what one task holds of texts at once.
BLOCK_WORDS = 1_000_000
#: Tokens for each count range: a count task holds the requests for at most as many words or pairs.
RANGE_WORDS = 3_000_000
#: The weights depend on the binary logarithm of the predecessor's count, up to this bucket.
BUCKETS = 16
#: Leave-one-out probabilities are gathered in cells of this many per factor of ten; the
#: weights, not the scores, rest on the cells.
CELLS = 8
DEEPEST = 16
ROUNDS = 50
_END_HASH = 0x5DEECE66D1CE4E5B


def _tokens(known: WordHashes, text: bytes | None) -> np.ndarray:
    words = lower_words(text)
    hashes = np.empty(len(words) + 1, np.uint64)
    hashes[:-1] = known.of(words)
    hashes[-1] = _END_HASH
    return hashes


#: Counts from here on are kept apart in 64 bits.
WIDE = 0xFFFFFFFF

BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("held", pa.bool_()),
        ("ids", pa.list_(pa.int64())),
        ("ends", pa.binary()),
        ("words", pa.binary()),
        ("places", pa.binary()),
    ]
)
REQUEST = pa.schema(
    [
        ("range", pa.int32()),
        ("kind", pa.int32()),
        ("block", pa.int64()),
        ("held", pa.bool_()),
        ("hashes", pa.binary()),
        ("counts", pa.binary()),
    ]
)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """``<block, held, ids, ends, words, places>``: whole texts, held-out ones in blocks of their own.

    ``words`` are the sorted distinct hashes of a block, ``places`` the place of every token among them.
    """

    def gather(batches):
        known = WordHashes()
        part, n = TaskContext.get().partitionId() << 32, 0
        open_blocks = {False: ([], []), True: ([], [])}
        sizes = {False: 0, True: 0}

        def close(held: bool):
            nonlocal n
            ids, rows = open_blocks[held]
            words, places = np.unique(np.concatenate(rows), return_inverse=True)
            ends = np.cumsum([len(row) for row in rows]).astype(np.int64)
            row = (part + n, held, ids, ends.tobytes(), words.tobytes(), places.astype(np.uint32).tobytes())
            n, open_blocks[held], sizes[held] = n + 1, ([], []), 0
            return _arrow([row], BLOCK)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts):
                tokens = _tokens(known, text)
                open_blocks[held][0].append(doc_id)
                open_blocks[held][1].append(tokens)
                sizes[held] += len(tokens)
                if sizes[held] >= block_words:
                    yield close(held)
        for held in (False, True):
            if sizes[held]:
                yield close(held)

    return docs.mapInArrow(gather, "block long, held boolean, ids array<long>, ends binary, words binary, places binary")


class _Block:
    """One row of the blocks, with its distinct pairs of neighbours in the order of their hashes."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held = list(row["ids"]), bool(row["held"])
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.places = np.frombuffer(row["places"], np.uint32)
        # Before the first word of a text stands an end token, which every block has.
        before = np.empty_like(self.places)
        before[1:] = self.places[:-1]
        before[np.r_[0, self.ends[:-1]]] = np.searchsorted(self.words, np.uint64(_END_HASH))
        self.before = before
        hashes = fold([self.words[before], self.words[self.places]])
        self.pairs, self.pair_places = np.unique(hashes, return_inverse=True)


def _planes(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, whose upper planes compress to nothing."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64)
    return np.cumsum(steps.ravel(), dtype=np.uint64)


def _requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """``<range, kind, block, held, hashes, counts>``: what a block asks of a range, with its own training counts."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, rows = _Block(row), []
                for kind, hashes, places in ((1, block.words, block.places), (2, block.pairs, block.pair_places)):
                    counts = np.bincount(places, minlength=len(hashes)).astype(np.uint32)
                    # Only the ranges that the block's hashes fall into.
                    own, starts = np.unique(_range_of(hashes, ranges), return_index=True)
                    for k, a, b in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
                        told = b"" if block.held else counts[a:b].tobytes()
                        rows.append((k, kind, row["block"], block.held, _planes(hashes[a:b]), told))
                yield _arrow(rows, REQUEST)

    return blocks.mapInArrow(ask, "range int, kind int, block long, held boolean, hashes binary, counts binary")


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash, rising with it."""
    return np.minimum((hashes.astype(np.float64) * (ranges / 2.0**64)).astype(np.int64), ranges - 1)


def _folded(totals: np.ndarray) -> tuple[bytes, bytes]:
    """Totals in 32 bits, and in 64 bits those that are too wide, which WIDE stands for in the former."""
    wide = totals >= WIDE
    return np.where(wide, WIDE, totals).astype(np.uint32).tobytes(), totals[wide].astype(np.int64).tobytes()


def _unfolded(totals: bytes, wide: bytes) -> np.ndarray:
    found = np.frombuffer(totals, np.uint32).astype(np.float64)
    if wide:
        found[found == WIDE] = np.frombuffer(wide, np.int64)
    return found


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of one range and kind; every block gets them in the order of its hashes."""
    asked = [_values(planes) for planes in rows["hashes"]]
    told = [np.zeros(len(own), np.uint32) if held else np.frombuffer(c, np.uint32) for c, own, held in zip(rows["counts"], asked, rows["held"])]
    hashes, places = np.unique(np.concatenate(asked), return_inverse=True)
    # Sums in doubles are exact up to 2**53.
    totals = np.bincount(places, np.concatenate(told), len(hashes)).astype(np.int64)
    answers, start = [], 0
    for own in asked:
        answers.append(_folded(totals[places[start : start + len(own)]]))
        start += len(own)
    # What the training texts hold in this range, told in one row.
    tokens, distinct = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    tokens[0], distinct[0] = totals.sum(dtype=np.int64), (totals > 0).sum()
    named = {"block": rows["block"], "held": rows["held"], "kind": rows["kind"], "range": rows["range"]}
    narrow, wide = zip(*answers)
    return pd.DataFrame({**named, "totals": narrow, "wide": wide, "tokens": tokens, "distinct": distinct})


def _estimates(block_rows: pd.DataFrame, answers: pd.DataFrame) -> tuple[_Block, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a block: its count, that of the pair it ends and that of its predecessor."""
    block = _Block(block_rows.iloc[0].to_dict())
    totals = {}
    for kind, rows in answers.sort_values("range").groupby("kind"):
        totals[kind] = np.concatenate([_unfolded(t, w) for t, w in zip(rows["totals"], rows["wide"])])
    return block, totals[1][block.places], totals[2][block.pair_places], totals[1][block.before]


def _parts(own, pair, before, n_tokens: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Bucket of the context and the three estimates that are mixed.

    Without a count to divide by, an estimate is that of the next shorter context.
    """
    uniform = 1.0 / (n_words + 1)
    alone = own / n_tokens if n_tokens > 0 else np.full(len(own), uniform)
    bucket = np.where(before > 0, np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64) + 1, BUCKETS), 0)
    after = np.where(before > 0, pair / np.maximum(before, 1), alone)
    return bucket, after, alone, uniform


def learn_weights(cells: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights ``[bucket, estimate]`` (pair, word, uniform) by expectation maximisation over leave-one-out cells."""
    weights = np.full((BUCKETS + 1, 3), 1 / 3)
    bucket, n = cells["bucket"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    # The means of a cell stand for the probabilities in it.
    given = np.stack([cells["pair"] / n, cells["word"] / n, np.full(len(cells), uniform)], axis=1)
    for _ in range(ROUNDS):
        shares = weights[bucket] * given
        shares *= (n / shares.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, shares[:, k], BUCKETS + 1) for k in range(3)], axis=1)
        # One observation for each estimate keeps every weight above zero.
        weights = (sums + 1) / (sums + 1).sum(axis=1, keepdims=True)
    return weights


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log10(p) * CELLS), 0, DEEPEST * CELLS), DEEPEST * CELLS + 1).astype(np.int64)


def scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``<doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score>``, one row per row of ``docs``.

    Tokens are the words (A-Z in lower case) and an end token. Counts are of
    all tokens of the documents that are not held out. ``base_score`` is the
    add-one unigram score, ``score`` that of the interpolated model; both are
    base-10 logarithms of the probability of the whole text. The weights of the
    model come from all training texts by leave-one-out counts: (c - 1) / (N - 1).

    * Null and empty texts have the end token alone.
    * A document with a null id is held out of the counts and scored.
    * Repeated rows are counted and scored as often as they occur.
    * Without training documents all estimates are uniform; an empty table
      gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held_out_too = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), held_out_too.alias("held_out"), "text")
    # In buckets, so that blocks are not moved when their counts come back.
    with bucketed(_blocks(rows, block_words), "lm-blocks", "block") as blocks:
        tokens = blocks.agg(F.sum(F.octet_length("places"))).first()[0] or 0
        ranges = max(1, math.ceil(tokens / 4 / RANGE_WORDS))
        schema = "block long, held boolean, kind int, range int, totals binary, wide binary, tokens long, distinct long"
        asked = _requests(blocks, ranges).groupBy("range", "kind")
        # Sums go back to the buckets of their blocks once, for the weights and for the scores.
        sums = asked.applyInPandas(_answer, schema).repartition(bucket_count(spark), "block")
        with bucketed(sums, "lm-counts", "block") as answers:
            counted = answers.filter("kind = 1").agg(F.sum("tokens"), F.sum("distinct")).first()
            n_tokens, n_words = int(counted[0] or 0), int(counted[1] or 0)

            def cogrouped(function, schema: str, which: str) -> DataFrame:
                given = answers.filter(which).select("block", "kind", "range", "totals", "wide").groupBy("block")
                return blocks.filter(which).groupBy("block").cogroup(given).applyInPandas(function, schema)

            def left_out_cells(block_rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
                _, own, pair, before = _estimates(block_rows, given)
                bucket, after, alone, _ = _parts(own - 1, pair - 1, before - 1, n_tokens - 1, n_words)
                levels = {"bucket": bucket, "pair_level": _level(after), "word_level": _level(alone)}
                return pd.DataFrame({**levels, "n": 1, "pair": after, "word": alone}).groupby(list(levels), as_index=False).sum()

            # At most (BUCKETS + 1) * (DEEPEST * CELLS + 2) ** 2 cells, whatever the input.
            schema = "bucket long, pair_level long, word_level long, n long, pair double, word double"
            cells = cogrouped(left_out_cells, schema, "NOT held").groupBy("bucket", "pair_level", "word_level")
            cells = cells.agg(*(F.sum(c).alias(c) for c in ("n", "pair", "word"))).toPandas()
            weights = learn_weights(cells.sort_values(["bucket", "pair_level", "word_level"]), 1.0 / (n_words + 1))

            def score(block_rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
                block, own, pair, before = _estimates(block_rows, given)
                bucket, after, alone, uniform = _parts(own, pair, before, n_tokens, n_words)
                mixed = weights[bucket, 0] * after + weights[bucket, 1] * alone + weights[bucket, 2] * uniform
                starts = np.r_[0, block.ends[:-1]]
                return pd.DataFrame(
                    {
                        "doc_id": pd.array(block.ids, dtype="Int64"),
                        "held_out": block.held,
                        "n_tokens": np.diff(block.ends, prepend=0),
                        "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
                        "base_score": np.add.reduceat(np.log10((own + 1) / (n_tokens + n_words + 1)), starts),
                        "score": np.add.reduceat(np.log10(mixed), starts),
                    }
                )

            schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
            scored = materialise(cogrouped(score, schema, "true"), "lm-scores")
    scored = scored.withColumn("train_tokens", F.lit(n_tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
