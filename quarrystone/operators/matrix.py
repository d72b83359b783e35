"""Vectors of Arrow batches as matrices, and their scores by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at once, at most: 4 MB, and some copies of them.
CELLS = 1 << 19


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have this dimension and only finite elements, and those vectors."""
    ok = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten()
    v = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    whole = np.isfinite(v).all(1)
    return ok[whole], v[whole]


def scores(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows of q against rows of c; squared distances rank like distances."""
    if metric == "euclidean":
        return 2 * (q @ c.T) - (q * q).sum(1)[:, None] - (c * c).sum(1)[None, :]
    s = q @ c.T
    if metric == "dot":
        return s
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    return np.divide(s, n, out=np.zeros_like(s), where=n != 0)


def cuts(n: int, step: int) -> Iterator[slice]:
    """0 to n in slices."""
    return (slice(i, i + step) for i in range(0, n, step))


def nearest(metric: str, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c that scores best for each row of v, of equal ones the first. Rows go in slices, so that memory doesn't grow with their number times that of c."""
    each = [scores(metric, v[x], c).argmax(1) for x in cuts(len(v), max(1, CELLS // len(c)))]
    return np.concatenate(each) if each else np.zeros(0, np.int64)


def paired(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of rows of a with the same rows of b, summed row by row: equal rows give equal scores wherever they stand."""
    if metric == "euclidean":
        return -np.sqrt(((a - b) ** 2).sum(1))
    s = (a * b).sum(1)
    if metric == "dot":
        return s
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.divide(s, n, out=np.zeros_like(s), where=n != 0)
