"""NumPy kernels that work on one Arrow batch or one bounded tile of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a distance block held at once by one task (float64, so 32 MB).
BLOCK_CELLS = 4_000_000
#: Largest integer that float64 arithmetic keeps exact.
EXACT_FLOAT = 2.0**53


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column without nulls and with equal lengths -> float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column)
    least, most = pc.min_max(lengths).values()
    if least != most:
        raise ValueError(f"vectors have different lengths, from {least} to {most} values")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def row_blocks(n_rows: int, row_cells: int):
    """Slices of at most ``BLOCK_CELLS`` cells."""
    step = max(1, BLOCK_CELLS // max(1, row_cells))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def direct_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed value by value; the same whatever the blocks."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1] if a.size else 0):
        diff = np.subtract.outer(a[:, j], b[:, j])
        diff *= diff
        total += diff
    return total


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two blocks.

    Whole numbers give exact results by matrix products: in float64 while no
    intermediate passes 2**53, else in 64-bit integers. Other values are summed
    directly, as expanding the square would cancel.
    """
    if not ((a == np.rint(a)).all() and (b == np.rint(b)).all()):
        return direct_distances(a, b)
    top = 2 * (np.einsum("ij,ij->i", a, a).max(initial=0.0) + np.einsum("ij,ij->i", b, b).max(initial=0.0))
    if top >= EXACT_FLOAT:
        ai, bi = a.astype(np.int64), b.astype(np.int64)
        return (
            np.einsum("ij,ij->i", ai, ai)[:, None]
            + np.einsum("ij,ij->i", bi, bi)[None, :]
            - 2 * (ai @ bi.T)
        )
    return _expanded(a, b)


def _expanded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a_norm = np.einsum("ij,ij->i", a, a)
    b_norm = np.einsum("ij,ij->i", b, b)
    return np.maximum(a_norm[:, None] + b_norm[None, :] - 2.0 * (a @ b.T), 0.0)


def nearest_row(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (lowest on ties) and its squared distance."""
    n, dim = points.shape
    best = np.zeros(n, dtype=np.int64)
    scale = np.einsum("ij,ij->i", centers, centers).max(initial=0.0)
    for block in row_blocks(n, len(centers)):
        x = points[block]
        d = _expanded(x, centers)
        pick = d.argmin(axis=1)
        # The matrix product rounds, so rows with a close runner-up are
        # settled on directly summed differences.
        slack = 1e-9 * (np.einsum("ij,ij->i", x, x) + scale)
        close = np.flatnonzero((d <= d[np.arange(len(x)), pick][:, None] + slack[:, None]).sum(axis=1) > 1)
        for part in row_blocks(len(close), len(centers)):
            rows = close[part]
            pick[rows] = direct_distances(x[rows], centers).argmin(axis=1)
        best[block] = pick
    distance = np.zeros(n)
    for j in range(dim):
        diff = points[:, j] - centers[best, j]
        distance += diff * diff
    return best, distance


def smallest_per_row(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest cells of each row, ties to the lower column."""
    k = min(k, d.shape[1])
    if k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero(d <= limit[:, None])
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(d)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def list_array(flat: np.ndarray, lengths: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=value_type))
