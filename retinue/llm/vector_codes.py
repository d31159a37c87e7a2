"""Product-quantised vector codes: exact k-means codebooks, with norm-of-sum bounds against needless distances.

Vectors are cut into consecutive parts and every part position gets a codebook
of its own, trained by rounds of exact integer k-means. Each part of a vector
keeps the entry it is assigned to and, per group of entries, a lower bound on
the distance to the other entries of the group together with the round in which
the bound was measured. As the codebooks of all rounds are kept, a bound is
lowered by how far the entries have come since its round in a straight line:
the norm of the sum of their steps, which is never more than the sum of the
norms. Only groups whose lowered bound still reaches the assigned entry are
measured again, exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.llm.spread import spread_join
from retinue.session import materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components become floor(SCALE * x).
SCALE = 1024
#: Entries that share one lower bound.
GROUP = 32
#: Integers of larger size could overflow a sum of 256 squared differences in 64 bits.
LARGEST = 1 << 26
#: Up to this size, products and sums of a part of at most 512 components are exact in doubles.
EXACT_IN_DOUBLE = 1 << 20
#: Relative slack that covers the rounding of roots and of the stored bounds.
SLACK = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """Codebooks of all rounds so far: ``history[t][p]`` holds the integer entries of part ``p`` after ``t`` rounds."""

    history: tuple[np.ndarray, ...]

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def moved(self) -> np.ndarray:
        """``[t, part, group]``: the farthest that an entry of the group lies from where it was after ``t`` rounds."""
        parts, entries, _ = self.last.shape
        groups = -(-entries // GROUP)
        found = np.zeros((len(self.history), parts, groups))
        for t, past in enumerate(self.history):
            net = self.last.astype(np.float64) - past
            far = np.sqrt((net * net).sum(axis=2)) * (1 + SLACK)
            for g in range(groups):
                found[t, :, g] = far[:, g * GROUP : (g + 1) * GROUP].max(axis=1)
        return found


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries, as 64-bit integers."""
    width = max(x.shape[1], 1)
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if top <= EXACT_IN_DOUBLE and width <= 512:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return found.astype(np.int64)
    found = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):
        found += np.square(x[:, d : d + 1] - entries[None, :, d])
    return found


@dataclass
class State:
    """Assignments of the rows of one part: entry, and per group a lower bound with the round it was measured in."""

    entry: np.ndarray
    bound: np.ndarray
    stamp: np.ndarray


def first_assignment(x: np.ndarray, entries: np.ndarray, now: int) -> tuple[State, np.ndarray]:
    groups = -(-len(entries) // GROUP)
    state = State(np.zeros(len(x), np.int64), np.zeros((len(x), groups), np.float32), np.full((len(x), groups), now, np.uint8))
    found = squared(x, entries)
    state.entry = found.argmin(axis=1)
    error = found[np.arange(len(x)), state.entry]
    for g in range(groups):
        state.bound[:, g] = _others(found[:, g * GROUP : (g + 1) * GROUP], state.entry - g * GROUP)
    return state, error


def _others(found: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance to the nearest entry of a group besides the assigned one, rounded down."""
    rest = found.astype(np.float64)
    inside = np.flatnonzero((own >= 0) & (own < found.shape[1]))
    rest[inside, own[inside]] = np.inf
    return (np.sqrt(rest.min(axis=1)) * (1 - SLACK)).astype(np.float32)


def assign(x: np.ndarray, entries: np.ndarray, state: State, moved: np.ndarray, now: int) -> tuple[State, np.ndarray, int]:
    """Nearest entries (ties to the lower index), their squared distances, and how many groups were measured.

    ``moved[t, g]`` is the farthest net displacement of an entry of group ``g`` since round ``t``.
    """
    rows = np.arange(len(x))
    step = x - entries[state.entry]
    before = (step * step).sum(axis=1)
    reach = np.sqrt(before.astype(np.float64)) * (1 + SLACK)
    groups = state.bound.shape[1]
    lowered = state.bound * (1 - SLACK) - moved[state.stamp, np.arange(groups)]
    entry, error = state.entry.copy(), before.copy()
    measured: list[tuple[int, np.ndarray, np.ndarray]] = []
    # A bound equal to the distance is measured too: the tie may go to a lower index.
    for g in range(groups):
        near = np.flatnonzero(lowered[:, g] <= reach)
        if not len(near):
            continue
        found = squared(x[near], entries[g * GROUP : (g + 1) * GROUP])
        measured.append((g, near, found))
        best = found.argmin(axis=1)
        least, index = found[np.arange(len(near)), best], best + g * GROUP
        better = (least < error[near]) | ((least == error[near]) & (index < entry[near]))
        entry[near[better]], error[near[better]] = index[better], least[better]
    bound, stamp = state.bound.copy(), state.stamp.copy()
    for g, near, found in measured:
        bound[near, g] = _others(found, entry[near] - g * GROUP)
        stamp[near, g] = now
    # The entry that was left counts among the others of its group, if that was not measured.
    left = rows[entry != state.entry]
    home = state.entry[left] // GROUP
    stale = stamp[left, home] != now
    left, home = left[stale], home[stale]
    own = np.sqrt(before[left].astype(np.float64)) * (1 - SLACK)
    bound[left, home] = np.maximum(np.minimum(lowered[left, home], own), 0) * (1 - SLACK)
    stamp[left, home] = now
    return State(entry, bound, stamp), error, sum(len(near) for _, near, _ in measured)


def _integers(batches):
    """Rows with finite components only, as integers."""
    for batch in batches:
        column = batch.column("embedding")
        x = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
        ends = column.offsets.to_numpy()
        # A null component reads as not a number here.
        finite, x = np.isfinite(x), np.floor(x * SCALE)
        keep, packed = [], []
        for n in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
            row = slice(ends[n], ends[n + 1])
            if not finite[row].all():
                continue
            if np.abs(x[row]).max(initial=0) > LARGEST:
                raise OverflowError(f"components beyond {LARGEST / SCALE:.0f} in size have no exact 64-bit distances")
            keep.append(n)
            packed.append(x[row].astype("<i4").tobytes())
        kept = batch.take(pa.array(keep, pa.int64()))
        columns = [kept.column("vec_id"), kept.column("label"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x"])


def _unpack(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _pack(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _advance(batch: pa.RecordBatch, books: Codebooks, moved: np.ndarray) -> tuple[np.ndarray, list[State], list[np.ndarray], int]:
    """The batch's integers, and per part its new state and errors; also how many groups were measured."""
    parts, entries, width = books.last.shape
    groups = moved.shape[2]
    now = len(books.history) - 1
    x = _unpack(batch.column("x"), "<i4", parts * width).astype(np.int64)
    states, errors, measured = [], [], 0
    old = "entry" in batch.schema.names
    if old:
        entry = _unpack(batch.column("entry"), "<u2", parts)
        bound = _unpack(batch.column("bound"), "<f4", parts * groups)
        stamp = _unpack(batch.column("stamp"), "u1", parts * groups)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        if old:
            part = slice(p * groups, (p + 1) * groups)
            state = State(entry[:, p].astype(np.int64), bound[:, part], stamp[:, part])
            state, error, n = assign(own, books.last[p], state, moved[:, p], now)
            measured += n
        else:
            state, error = first_assignment(own, books.last[p], now)
            measured += len(own) * groups
        states.append(state)
        errors.append(error)
    return x, states, errors, measured


#: Columns that carry a row from round to round.
STATE = T.StructType([T.StructField(name, T.BinaryType()) for name in ("x", "entry", "bound", "stamp")])


def _round(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with every part assigned to the latest codebooks, its state renewed."""
    moved = books.moved()

    def work(batches):
        for batch in batches:
            _, states, _, _ = _advance(batch, books, moved)
            columns = [
                batch.column("vec_id"),
                batch.column("label"),
                batch.column("x"),
                _pack(np.stack([s.entry for s in states], axis=1).astype("<u2")),
                _pack(np.concatenate([s.bound for s in states], axis=1).astype("<f4")),
                _pack(np.concatenate([s.stamp for s in states], axis=1).astype("u1")),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", *STATE.names])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], *STATE.fields])
    return rows.mapInArrow(work, schema)


def _sums(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """``[part, entry, 1 + width]``: how many parts each entry has, and their sum.

    Every task sends one row per entry it uses; the driver gets one per entry of the codebooks.
    """
    parts, entries, width = shape

    def work(batches):
        total = np.zeros((parts * entries, 1 + width), np.int64)
        for batch in batches:
            x = _unpack(batch.column("x"), "<i4", parts * width).astype(np.int64)
            entry = _unpack(batch.column("entry"), "<u2", parts).astype(np.int64)
            for p in range(parts if len(x) else 0):
                order = np.argsort(entry[:, p], kind="stable")
                slots, starts, counts = np.unique(entry[order, p], return_index=True, return_counts=True)
                total[slots + p * entries, 0] += counts
                total[slots + p * entries, 1:] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
        used = np.flatnonzero(total[:, 0])
        ends = np.arange(len(used) + 1, dtype=np.int32) * (1 + width)
        sums = pa.ListArray.from_arrays(pa.array(ends), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), sums], ["slot", "sums"])

    found = rows.select("x", "entry").mapInArrow(work, "slot long, sums array<long>")
    columns = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(1 + width)]
    total = np.zeros((parts * entries, 1 + width), np.int64)
    for row in found.groupBy("slot").agg(*columns).collect():
        total[row["slot"]] = row[1:]
    return total.reshape(parts, entries, 1 + width)


def _moved_on(entries: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), entries)


def _drop(written: DataFrame) -> None:
    """Delete an intermediate table whose successor is written."""
    spark = written.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(written.inputFiles()[0]).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``<vec_id, label, x>`` of the rows that are coded, with their integers, and the common number of components."""
    picked = vectors.select("vec_id", "label", "embedding")
    schema = T.StructType([picked.schema["vec_id"], picked.schema["label"], T.StructField("x", T.BinaryType())])
    rows = materialise(picked.mapInArrow(_integers, schema), "codes-integers")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.length("x").alias("n")).filter(f"n > 0 AND n % {4 * PARTS} = 0").first()
    size = first["n"] if first else 0
    return rows.filter(F.length("x") == size) if size else rows.limit(0), size // 4


def train(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """Codebooks after ``rounds`` rounds, and ``rows`` assigned to the last but one of them.

    Each round reads the written rows of the one before and writes its own; what
    the one before wrote is deleted then.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([np.frombuffer(row["x"], "<i4") for row in first], np.int64)
    books = Codebooks((start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2),))
    state = rows
    for n in range(rounds):
        before, state = state, materialise(_round(state, books), "codes-round")
        if n:
            _drop(before)
        total = _sums(state, books.last.shape)
        books = Codebooks((*books.history, _moved_on(books.last, total)))
    return books, state


def encode(state: DataFrame, books: Codebooks) -> DataFrame:
    """``<vec_id, label, code, error>``: entry of every part as two hex digits each, and the sum of squared distances."""
    moved = books.moved()

    def work(batches):
        for batch in batches:
            _, states, errors, _ = _advance(batch, books, moved)
            codes = np.stack([s.entry for s in states], axis=1).astype("u1")
            texts = pa.array([row.tobytes().hex() for row in codes], pa.string())
            columns = [batch.column("vec_id"), batch.column("label"), texts, pa.array(np.sum(errors, axis=0, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    texts = T.StructType.fromDDL("code string, error long")
    return state.mapInArrow(work, T.StructType([state.schema["vec_id"], state.schema["label"], *texts.fields]))


def digest_text(books: Codebooks) -> str:
    """All final components by part, entry and position within the part, joined by commas."""
    return ",".join(map(str, books.last.ravel().tolist()))


def vector_codes(vectors: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """``<vec_id, label, code, error, label_error>`` of the rows of ``<vec_id, embedding, label>``, and the codebooks.

    Other columns of ``vectors`` are not read.

    * Rows whose vector is null or holds a null or non-finite component are left out.
    * The vectors have one length, a positive multiple of the number of parts: that of the
      smallest ``vec_id`` for which this holds. Rows of another length (empty ones too) are left out.
    * A null ``vec_id`` sorts behind all others; repeated rows are rows like others, and among
      equal ids the order of their components decides which are the first entries.
    * With fewer rows than entries the codebooks are that much smaller. An empty table gives an
      empty result and no codebooks.
    * Null labels count as one label.
    * A component of more than 2**16 in size ends the job with an error: distances would exceed 64 bits.
    """
    rows, width = usable(vectors)
    if not width:
        nothing = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.withColumn("label_error", F.col("error")), None
    books, state = train(rows, width)
    coded = materialise(encode(state, books), "codes-final")
    _drop(state)
    coded = coded.withColumn("_label", F.to_json(F.struct("label")))
    totals = materialise(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "codes-labels")
    found = spread_join(coded, totals.select("_label", "label_error"), "_label", ["vec_id", "code"], sizes=totals.select("_label", "_n"))
    return found.select("vec_id", "label", "code", "error", "label_error"), books
