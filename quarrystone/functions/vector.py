"""Vector arithmetic as columns: sums over elements, without Python functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")
#: Query vectors up to this length become one codegen expression; longer ones a higher-order function.
UNROLL = 128


def _tree(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
    return terms[0] if terms else F.lit(0.0)


def _sum(a: Column, b: Column | Sequence[float], f) -> Column:
    """The sum of f over paired elements, up to the shorter vector's end."""
    zero = F.lit(0.0)
    if isinstance(b, Column):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(f(x.cast("double"), y.cast("double")), zero)), zero, lambda s, x: s + x)
    if len(b) <= UNROLL:
        return _tree([F.coalesce(f(F.get(a, F.lit(i)).cast("double"), F.lit(float(y))), zero) for i, y in enumerate(b)])
    return _sum(a, F.array(*[F.lit(float(y)) for y in b]), f)


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _norm_of(b: Column | Sequence[float]) -> Column:
    return norm(b) if isinstance(b, Column) else F.lit(sum(float(x) * float(x) for x in b) ** 0.5)


def cosine(a: Column, b: Column | Sequence[float], norm_a: Column | None = None) -> Column:
    """0 if either vector has no length. norm_a: a stored norm of a."""
    n = (norm_a if norm_a is not None else norm(a)) * _norm_of(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_euclidean(a: Column, b: Column | Sequence[float]) -> Column:
    return -_sum(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column | Sequence[float]) -> Column:
    return -F.sqrt(-squared_euclidean(a, b))


def score(metric: str, a: Column, b: Column | Sequence[float], norm_a: Column | None = None) -> Column:
    """Higher is closer, in every metric."""
    if metric == "cosine":
        return cosine(a, b, norm_a)
    return {"dot": dot, "euclidean": euclidean}[metric](a, b)


def signature(a: Column, dimension: int) -> Column:
    """Sign bits in 64-bit words: bit i of word i // 64 is set if element i is not negative."""
    words = []
    for w in range(0, dimension, 64):
        bits = [F.when(F.get(a, F.lit(i)) >= 0, F.shiftleft(F.lit(1).cast("long"), i - w)).otherwise(F.lit(0).cast("long")) for i in range(w, min(w + 64, dimension))]
        while len(bits) > 1:
            bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=False)] + bits[len(bits) - len(bits) % 2 :]
        words.append(bits[0])
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures; 0 if their lengths differ."""
    each = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), each).otherwise(F.lit(0))


def quantised(metric: str, h: Column, dimension: int) -> Column:
    """The score that a Hamming distance stands for."""
    s = F.lit(float(dimension)) - 2.0 * h
    return {"dot": s, "cosine": s / F.lit(float(max(dimension, 1))), "euclidean": -h.cast("double")}[metric]
