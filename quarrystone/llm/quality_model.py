"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a better and a worse labelled document) fix a linear score by
logistic loss on feature differences, over every pair that labels give. No pair
is written down: the loss of a pair depends on the difference of two scores, so
a pass over the labelled rows gathers scores in narrow bins, the bins of both
sides are set against each other on the driver, and a second pass sums the
slopes. The cut is the quantile of the scores that leaves as many labelled
documents above it as are good; a logistic curve through it turns scores into
numbers from 0 to 1, 0.3 at the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, forget, table
from .linear import FEATURES, features, sigmoid

#: All pairs together weigh as much against the ridge as so many pairs would.
PAIRS = 60_000
RIDGE = 1.0
CUT = 0.3
#: Width of a bin of scores. Within bins the loss is expanded to the third order: a pair's slope is off by 3e-10 at most.
WIDTH = 1 / 64
#: Bits of a score that are fixed, from the highest on, when scores of a rank are looked for.
BITS = (64, 48, 36, 24, 12, 0)

#: A function of features and labels that gives keys and a row of numbers for each.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Runs such a function over all rows and sums the numbers of each key.
Sums = Callable[[Part], tuple[np.ndarray, np.ndarray]]


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and for each the sum of its rows of values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first, axis=0)


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, a column at a time: a row's score doesn't depend on the rows beside it."""
    s = np.zeros(len(x))
    for k, v in enumerate(w):
        s += x[:, k] * v
    return s


def binned(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row twice its bin plus its label, and how far it is from the bin's centre."""
    s = linear(x, w)
    b = np.floor(s / WIDTH)
    return b.astype(np.int64) * 2 + y, s - (b + 0.5) * WIDTH


def losses(t: np.ndarray) -> list[np.ndarray]:
    """The loss of pairs whose worse score is t above the better one, and its first four derivatives."""
    p = sigmoid(t)
    q = p * (1 - p)
    return [np.logaddexp(0, t), p, q, q * (1 - 2 * p), q * (1 - 6 * q)]


def against(keys: np.ndarray, v: np.ndarray, mean: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss over all pairs; each key's slope as a polynomial of the distance from its centre; its curvature; the cross term of the curvature.

    v: for each key the number of rows, the sums of their distances, of half
    the squares and a sixth of the cubes, and of their features.
    """
    good = keys & 1 == 1
    c = ((keys >> 1) + 0.5) * WIDTH
    pairs = v[good, 0].sum() * v[~good, 0].sum()
    mg, mb = v[good, :4].T, v[~good, :4].T
    xg, xb = (v[k, 4:] - v[k, :1] * mean for k in (good, ~good))
    d, curve, cross = np.zeros((5, len(keys))), np.zeros(len(keys)), np.zeros((len(mean), len(mean)))
    own, others = np.flatnonzero(good), np.flatnonzero(~good)
    step = max(1, (1 << 20) // max(len(others), 1))
    for a in range(0, len(own), step):
        part = own[a : a + step]
        f = losses(c[others] - c[part, None])
        for k in range(5):
            for m in range(min(3, 4 - k) + 1):
                d[k, part] += f[k + m] @ mb[m]
                d[k, others] += (-1) ** m * (mg[m, a : a + step] @ f[k + m])
        curve[part] = f[2] @ mb[0]
        curve[others] += mg[0, a : a + step] @ f[2]
        cross += xg[a : a + step].T @ f[2] @ xb
    loss = sum((-1) ** m * (mg[m] @ d[m, own]) for m in range(4))
    sign = np.where(good, -1.0, 1.0)
    slope = np.stack([d[1] * sign, d[2], d[3] * sign / 2, d[4] / 6])
    return float(loss / pairs), slope / pairs, curve / pairs, cross / pairs


def minimised(sums: Sums, n: int, pairs: float, ridge: float = RIDGE, steps: int = 50) -> tuple[np.ndarray, int, int]:
    """The n weights that minimise the loss over all pairs with a ridge penalty, by Newton's method, and how many rows are bad and good."""

    def gather(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, off = binned(x, y, w)
            return grouped(keys, np.column_stack([np.ones(len(x)), off, off**2 / 2, off**3 / 6, x]))

        return sums(part)

    w = np.zeros(n)
    keys, v = gather(w)
    bad, good = (int(v[keys & 1 == k, 0].sum()) for k in (0, 1))
    if not bad or not good:
        return w, bad, good
    mean = v[:, 4:].sum(0) / (bad + good)
    total = lambda at, w: pairs * at[0] + ridge / 2 * (w @ w)
    at = against(keys, v, mean)
    for _ in range(steps):
        _, slope, curve, cross = at

        def part(x: np.ndarray, y: np.ndarray, w=w, keys=keys, slope=slope, curve=curve) -> tuple[np.ndarray, np.ndarray]:
            own, off = binned(x, y, w)
            k = np.searchsorted(keys, own)
            x = x - mean
            g = x.T @ (slope[0, k] + off * (slope[1, k] + off * (slope[2, k] + off * slope[3, k])))
            return np.zeros(1, np.int64), np.append(g, (x * curve[k, None]).T @ x)[None]

        got = sums(part)[1][0]
        g = pairs * got[:n] + ridge * w
        h = pairs * (got[n:].reshape(n, n) - cross - cross.T) + ridge * np.eye(n)
        d = np.linalg.solve(h, g)
        before = total(at, w)
        while True:
            small = np.abs(d).max() < 1e-7
            keys, v = gather(w - d)
            at = against(keys, v, mean)
            if small or total(at, w - d) <= before + 1e-9 * pairs:  # off by so much at most
                break
            d /= 2
        w = w - d
        if small:
            break
    # sums of other partitions differ in their last bits
    return np.round(w, 6) + 0.0, bad, good


def ranked(sums: Sums, w: np.ndarray, wanted: list[tuple[int | None, int]]) -> list[float]:
    """The scores of the wanted ranks (label or None for all rows, place from 0 in ascending order), exactly, 16 or 12 bits in each pass."""
    prefix, place = np.zeros(len(wanted), np.uint64), [r for _, r in wanted]
    for above, below in zip(BITS, BITS[1:], strict=False):

        def part(x: np.ndarray, y: np.ndarray, prefix=prefix, above=above, below=below) -> tuple[np.ndarray, np.ndarray]:
            bits = (linear(x, w) + 0.0).view(np.uint64)
            top = np.uint64(1 << 63)
            bits = np.where(bits & top, ~bits, bits | top)  # in the order of the scores
            keys = []
            for i, (label, _) in enumerate(wanted):
                use = np.ones(len(x), bool) if label is None else y == label
                if above < 64:
                    use &= bits >> np.uint64(above) == prefix[i]
                digit = bits[use] >> np.uint64(below) & np.uint64((1 << above - below) - 1)
                keys.append((i << 16) + digit.astype(np.int64))
            keys = np.concatenate(keys)
            return grouped(keys, np.ones((len(keys), 1)))

        keys, n = sums(part)
        for i in range(len(wanted)):
            own = np.flatnonzero(keys >> 16 == i)
            upto = np.cumsum(n[own, 0])
            j = int(np.searchsorted(upto, place[i], "right"))
            place[i] -= int(upto[j - 1]) if j else 0
            prefix[i] = (int(prefix[i]) << above - below) + int(keys[own[j]] & 0xFFFF)
        prefix = prefix.copy()
    top = np.uint64(1 << 63)
    return np.where(prefix & top, prefix ^ top, ~prefix).view(float).tolist()


def fitted(sums: Sums, n: int, pairs: float) -> tuple[np.ndarray, float, float]:
    """Weights, cut and scale. Without rows of both labels every score is on one side: that of the label there is (good, if none)."""
    w, bad, good = minimised(sums, n, pairs)
    if not bad or not good:
        return w, 10.0 if bad else 0.0, 1.0
    middle = [(label, k) for label, m in ((1, good), (0, bad)) for k in ((m - 1) // 2, m // 2)]
    low, high, *of = ranked(sums, w, [(None, bad - 1), (None, bad), *middle])
    return w, (low + high) / 2, max(((of[0] + of[1]) / 2 - (of[2] + of[3]) / 2) / 8, 1e-6)


def fit(x: np.ndarray, y: np.ndarray, pairs: float = PAIRS) -> tuple[np.ndarray, float, float]:
    """Weights, cut and scale from the rows of an array."""
    y = np.asarray(y).astype(np.int64)
    return fitted(lambda part: grouped(*part(x, y)), x.shape[1], pairs)


def over(rows: DataFrame) -> Sums:
    """Sums over a table of label and x; tasks send a row of numbers for each of their keys."""

    def sums(part: Part) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = []
            join = lambda: grouped(*map(np.concatenate, zip(*parts, strict=True)))
            for b in batches:
                if b.num_rows:
                    parts.append(part(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("label").to_numpy().astype(np.int64)))
                if len(parts) == 32:
                    parts = [join()]
            if parts:
                keys, values = join()
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), TaskContext.get().partitionId(), np.int32)), pa.array(keys), lists], ["task", "key", "v"])

        got = rows.mapInArrow(run, "task int, key long, v array<double>").toArrow()  # keys: bins that hold scores, or digits
        if not got.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, 4 + FEATURES))
        order = np.argsort(got.column("task").to_numpy(), kind="stable")  # sums in a fixed order
        values = got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        return grouped(got.column("key").to_numpy()[order], values[order])

    return sums


def held_out(doc_id: str, parts: int, part: int):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, label, text of at most `sample` rows that have a label of 0 or 1: those with the least hashes of their ids.

    Equal rows count once. Where rows repeat an id there are more than labels,
    so they are cut again, by keys: no task holds all texts.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    rows = cut(rows.withColumn("h", F.xxhash64("text")), "labelled")
    key = ["doc_id", label, "h"]
    keys = rows.select(*key).distinct().orderBy(F.xxhash64("doc_id"), *key).limit(sample)
    return rows.join(F.broadcast(keys), key).dropDuplicates(key).drop("h")  # sample rows at most


def featured(docs: DataFrame) -> DataFrame:
    """A table of doc_id, h (hash of the text) and x (its features) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), lists], ["doc_id", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, x array<double>"), "featured")


def train(rows: DataFrame, labels: DataFrame, pairs: float = PAIRS) -> tuple[np.ndarray, float, float]:
    """rows: as featured() has them; labels: doc_id, label (0 or 1; others and nulls are left out; of several for a document each counts). Equal rows count once."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    key = ["doc_id", "label", "h"]
    known = rows.join(labels, "doc_id").dropDuplicates(key).sortWithinPartitions(*key).select("label", "x")
    known = cut(known, "labelled")
    model = fitted(over(known), FEATURES, pairs)
    forget(known)
    return model


def score(rows: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id, score for every row of a table that featured() has made."""
    w, cut, scale = model
    kind = rows.schema["doc_id"].dataType.simpleString()
    shift = np.log(CUT / (1 - CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sigmoid((linear(b.column("x").flatten().to_numpy().reshape(b.num_rows, len(w)), w) - cut) / scale + shift)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, pairs: float = PAIRS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Labels of held-out documents (crc32 of the id as text, mod parts, is part;
    a null id counts as an empty text) are never read. A null or empty text
    gets the score of a text without words; repeated rows get equal scores; a
    score at the cut is good (ties); of several labels for a document each
    counts; without labels all are predicted good; a text is read whole, the
    longest ones piece by piece; other columns are ignored; an empty table
    gives an empty result. All other labelled rows are learned from, and all
    their pairs, which weigh as much against the ridge as `pairs` would.
    """
    rows = featured(docs)
    out = score(rows, train(rows, labels.filter(~held_out("doc_id", parts, part)), pairs))
    return out.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality(table(spark, sf_dir, "documents"), labels)
