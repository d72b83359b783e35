"""How many buckets an approximate search probes and how many candidates it keeps."""

from __future__ import annotations

import math
from dataclasses import dataclass

SMALL = 20_000
MIN_VECTORS = 2_000
MAX_PROBES = 256
#: Files that an approximate search opens at most.
READS = 512
PRUNE_RATIO, PRUNE_FROM, RERANK = 0.05, 256, 2_048
#: Candidates that are scored exactly in any case; chosen by recall.
RERANK_LEAST = 512


def _step(k: int, steps: tuple[int, int, int, int, int]) -> int:
    return next((s for most, s in zip((5, 10, 25, 50), steps, strict=False) if k <= most), steps[-1])


def least_probes(k: int, buckets: int, filtered: bool) -> int:
    return min(max(1, _step(k, (12, 20, 22, 24, 26)) + 2 * filtered), buckets) if buckets else 0


@dataclass(frozen=True)
class Budget:
    candidates: int
    probes: int


def budget(k: int, vectors: int, buckets: int, filtered: bool = False, matches: int | None = None, small: int = SMALL) -> Budget:
    """matches: how many rows are expected to pass the filter; collections of at most `small` vectors are probed whole."""
    if not k or not vectors or not buckets:
        return Budget(0, 0)
    least = least_probes(k, buckets, filtered)
    if vectors <= small:
        want = vectors
    else:
        want = max(k, k * _step(k, (56, 48, 40, 32, 24))) * (2 if filtered else 1)
        if filtered and matches is not None:
            share = max(1, min(matches, vectors)) / vectors
            want = math.ceil(want * min(32.0, max(1.0, 1 / share)))
        want = min(vectors, max(want, -(-vectors // buckets) * least))
    per = vectors / buckets
    if filtered and matches:
        per = matches / buckets
    most = buckets if vectors <= small else min(MAX_PROBES, buckets)
    need = math.ceil(want / max(1.0, per))
    return Budget(want, max(1, min(max(need, least), max(most, least))))


def rerank_limit(k: int, first: int, ratio: float = PRUNE_RATIO, most: int = RERANK) -> int:
    """How many of the first stage's candidates are scored exactly."""
    if not k or not first:
        return 0
    share = min(1.0, max(0.01, ratio)) if first >= PRUNE_FROM else 1.0
    return min(max(math.ceil(first * share), k), max(most, k))


def bucket_count(vectors: int) -> int:
    return min(256, max(8, round(math.sqrt(vectors))))


def root_count(buckets: int) -> int:
    return min(32, max(2, round(math.sqrt(buckets))))
