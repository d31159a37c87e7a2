import numpy as np
import pytest
from pyspark.sql import functions as F

from retinue.llm import vector_codes as codes


def plain_codes(rows, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """All distances of all rounds, in Python's whole numbers."""
    good = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    x = {}
    for n, (i, v, _) in enumerate(good):
        x[n] = [int(np.floor(c * 1024)) for c in v]
    order = sorted(x, key=lambda n: (good[n][0] is None, good[n][0] or 0))
    width = len(good[0][1]) // 4
    part = lambda n, p: tuple(x[n][p * width : (p + 1) * width])
    books = [[part(n, p) for n in order[:entries]] for p in range(4)]

    def nearest(n, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(n, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for n in x:
                groups.setdefault(nearest(n, p)[1], []).append(part(n, p))
            for e, members in groups.items():
                books[p][e] = None, members
            books[p] = [tuple(sum(c) // len(b[1]) for c in zip(*b[1])) if b[0] is None else b for b in books[p]]
    found = [[nearest(n, p) for p in range(4)] for n in x]
    error = [sum(d for d, _ in row) for row in found]
    by_label = {}
    for n, e in zip(x, error):
        by_label[good[n][2]] = by_label.get(good[n][2], 0) + e
    out = [(good[n][0], "".join(f"{e:02x}" for _, e in row), e, by_label[good[n][2]]) for n, row, e in zip(x, found, error)]
    return sorted(out, key=repr), books


def vectors(n, dim, seed=3, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (12, dim))
    values = (centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dim))).astype(np.float32)
    return [(int(i) * 3, v.tolist(), int(i) % 3 if i % 7 else None) for i, v in enumerate(values)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"x": F.lit("clash"), "entry": F.lit(1), "_label": F.lit(2)})
    found, books = codes.vector_codes(frame)
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], key=repr), books


def test_codes_equal_all_distances(spark):
    rows = vectors(700, 8)
    found, books = run(spark, rows)
    want, plain = plain_codes(rows)
    assert found == want
    assert codes.digest_text(books) == ",".join(str(c) for part in plain for entry in part for c in entry)


def test_odd_rows(spark):
    """Fewer rows than entries, repeated rows, ties, and rows that are left out."""
    rows = vectors(40, 4)
    rows += [rows[5], rows[6], (None, [0.5, 0.25, 0.0, -0.5], 1), (1, rows[0][1], 1)]
    bad = [(500, None, 1), (501, [0.1, None, 0.2, 0.3], 1), (502, [0.1, float("nan"), 0.2, 0.3], None), (503, [float("inf"), 0.1, 0.1, 0.1], 2), (-9, [], 2), (504, [0.5] * 8, 2)]
    found, books = run(spark, rows + bad)
    assert len(books.last[0]) == len(rows)
    assert found == plain_codes(rows)[0]
    empty, none = run(spark, bad[:4])
    assert empty == [] and none is None
    empty, none = codes.vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error"] and empty.count() == 0


def test_large_components_are_exact_or_refused():
    x = np.array([[codes.LARGEST, 3], [-codes.LARGEST, 4]], np.int64)
    assert codes.squared(x, x[:1])[1, 0] == 4 * codes.LARGEST**2 + 1
    with pytest.raises(OverflowError):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"vec_id": [1], "label": [1], "embedding": [[1e6]]})
        list(codes._integers([batch]))


def test_bounds_leave_out_distances_and_net_moves_are_tighter():
    """Entries that move to and fro: the norm of the sum stays small, and fewer groups are measured than there are."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-30_000, 30_000, (8, 6))
    entries = (centres[np.arange(256) // 32] + rng.integers(-300, 300, (256, 6))).astype(np.int64)
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 6))
    step = rng.integers(-200, 200, entries.shape)
    history = [entries, entries + step, entries + 5]
    state, _ = codes.first_assignment(x, history[0], 0)
    measured = 0
    for now in (1, 2):
        books = codes.Codebooks(tuple(h[None] for h in history[: now + 1]))
        moved = books.moved()
        state, error, n = codes.assign(x, history[now], state, moved[:, 0], now)
        full = codes.squared(x, history[now])
        assert (state.entry == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
        measured += n
    assert measured < 0.3 * 2 * len(x) * 8
    drifts = sum(np.sqrt((np.diff(np.stack(history), axis=0)[t].astype(float) ** 2).sum(axis=1)) for t in range(2))
    assert moved[0, 0].max() < 0.2 * drifts.max()
