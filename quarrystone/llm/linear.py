"""Text features, counted with numpy over whole Arrow batches, and small linear models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import WHITE, Words, flat, words

_class = np.zeros((8, 256), bool)
_class[0, 65:91] = True  # upper case
_class[1, 97:123] = True  # lower case
_class[2, 48:58] = True  # digits
for _c in b"#*$%&|<>@^_~=+\\{}[]":
    _class[3, _c] = True  # symbols
for _c in b".,;:'\"()-":
    _class[4, _c] = True  # punctuation
for _c in b"!?":
    _class[5, _c] = True
_class[6, 10] = True  # line ends
_class[7, 128:192] = True  # continuation bytes
FEATURES = 16


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(w: Words, values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(ptr[:-1], ptr[1:], strict=True)], float)


def features(column: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text; a null or empty text has zeros but for the constant."""
    data, at = flat(column)
    out = []
    for w in words(column, WHITE, lower=True):
        n = np.diff(w.ptr).astype(float)
        size = np.diff(at[w.first : w.first + w.n + 1]).astype(float)
        counts = np.zeros((8, w.n))
        a = 0
        while a < w.n:  # some megabytes at once; one long text piece by piece
            b = max(a + 1, int(np.searchsorted(at, at[w.first + a] + (1 << 22), "right")) - 1 - w.first)
            b = min(b, w.n)
            lo, hi = int(at[w.first + a]), int(at[w.first + b])
            for p in range(lo, max(hi, lo + 1), 1 << 22):
                part, bounds = data[p : min(hi, p + (1 << 22))], np.clip(at[w.first + a : w.first + b + 1] - p, 0, min(hi - p, 1 << 22))
                for k in range(8):
                    counts[k, a:b] += _per_row(_class[k][part], bounds)
            a = b
        distinct = _distinct(w, w.hashes, w.ptr)
        pairs = w.hashes[:-1] * np.uint64(3) + w.hashes[1:] if len(w.hashes) > 1 else np.zeros(0, np.uint64)
        two = np.array([len(np.unique(pairs[a : max(a, b - 1)])) for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)], float)
        chars = np.maximum(size - counts[7], 1)
        tokens = np.maximum(n, 1)
        letters = np.maximum(counts[0] + counts[1], 1)
        x = np.stack(
            [
                np.ones(w.n),
                np.log1p(n),
                np.minimum(size / tokens, 40) / 10,
                counts[0] / letters,
                counts[2] / chars * 10,
                np.minimum(counts[3] / tokens, 2),
                (counts[3] > 0.1 * tokens).astype(float),
                np.minimum(counts[4] / tokens, 2),
                np.minimum(counts[5] / tokens, 2),
                (counts[5] > 0.2 * tokens).astype(float),
                np.minimum(counts[6] / tokens * 10, 3),
                distinct / tokens,
                np.where(n > 1, two / np.maximum(n - 1, 1), (n > 0).astype(float)),
                (np.where(n > 1, two / np.maximum(n - 1, 1), 1) < 0.7).astype(float),
                np.minimum(counts[7] / chars, 1),
                (counts[0] > 0.5 * letters).astype(float),
            ],
            1,
        )
        x[n == 0, 1:] = 0
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights that minimise the logistic loss with a ridge penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-9:
            break
    return w
