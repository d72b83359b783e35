"""Toxicity by a classifier chain.

Linear models predict categories one after another; each sees which marker
words a text holds and the probabilities of the earlier categories. For
training those probabilities are out-of-fold predictions, so a later model
never learns from an earlier one's memory of its own rows: a fold's markers and
weights come from the other folds alone. The last category is toxicity itself;
the earlier ones are kinds of toxic texts, found by k-means over the markers
that toxic training texts hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, table
from ._text import NOT_ALNUM, mix, words
from .linear import logistic, sigmoid
from .quality_model import held_out, labelled

#: At most so many labelled rows, those with the least hashes of their ids, are learned from.
SAMPLE = 20_000
#: Words are hashed to 2**BITS buckets, of which the MARKERS most telling are used.
BITS, MARKERS = 18, 384
#: Bytes of word beginnings: inflected forms share them.
PREFIXES = (5, 7)
FOLDS = 5
RIDGE = 1.0

#: Kinds of toxic texts that come before toxicity in the chain.
KINDS = 2


def buckets(column: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text: of its words (alphanumeric, A-Z lowered), of their beginnings, and of beginnings that it has twice."""
    out = []
    views = [words(column, NOT_ALNUM, lower=True, prefix=n) for n in (None, *PREFIXES)]
    for batch in zip(*views, strict=True):
        for r in range(batch[0].n):
            own = []
            for k, w in enumerate(batch):
                once, n = np.unique(w.hashes[w.ptr[r] : w.ptr[r + 1]], return_counts=True)
                own.append(mix(once + np.uint64(k)))
                if k:
                    own.append(mix(once[n > 1] + np.uint64(k + 8)))
            out.append(np.unique((np.concatenate(own) >> np.uint64(64 - BITS)).astype(np.int32)))
    return out


@dataclass
class Chain:
    names: list[str]
    markers: np.ndarray
    weights: list[np.ndarray]
    cut: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w)[:, None]])
        return x[:, len(self.markers) + 1 :]


def matrix(rows: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
    """A constant and which of the markers (sorted) each row holds."""
    x = np.zeros((len(rows), len(markers) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        j = np.searchsorted(markers, r)
        j[j == len(markers)] = 0
        x[i, j[markers[j] == r] + 1 if len(markers) else []] = 1
    return x


def kinds(x: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """Clusters 0..k-1 of rows by the direction of their markers: spherical k-means from the row farthest from all centres so far."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    if len(x) < k:
        return np.zeros(len(x), int)
    centres = x.mean(0, keepdims=True)
    while len(centres) < k + 1:
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    centres = centres[1:]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, 1)
        new = np.stack([x[at == j].sum(0) if (at == j).any() else centres[j] for j in range(k)])
        new = np.divide(new, np.linalg.norm(new, axis=1, keepdims=True), out=np.zeros_like(new), where=np.linalg.norm(new, axis=1, keepdims=True) > 0)
        if np.allclose(new, centres):
            break
        centres = new
    return at


def fit(x: np.ndarray, folds: list[np.ndarray], fold: np.ndarray, y: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Weights of each category's model, the out-of-fold probabilities (a column for each), and the cut.

    x: the markers of each row, as chosen on all rows; folds: the same as
    chosen without each fold; fold: of each row; y: labels of each category in
    the chain's order, the last one toxicity. Rows must be in a fixed order.
    """
    n = len(fold)
    with_one = lambda m: np.hstack([np.ones((len(m), 1)), m.astype(float)])
    weights, out = [], np.zeros((n, 0))
    for name in y:
        p = np.zeros(n)
        for f, own in enumerate(folds):
            rest = fold != f
            if not rest.all():
                w = logistic(np.hstack([with_one(own[rest]), out[rest]]), y[name][rest], RIDGE)
                p[~rest] = sigmoid(np.hstack([with_one(own[~rest]), out[~rest]]) @ w)
        weights.append(logistic(np.hstack([with_one(x), out]), y[name], RIDGE))
        out = np.hstack([out, p[:, None]])
    # the cut with the best F1 of out-of-fold predictions, midway between two neighbours
    cut_at, last = 0.5, y[list(y)[-1]]
    if 0 < last.sum() < n:
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(last[order])
        k = int((2 * hits / (np.arange(1, n + 1) + last.sum())).argmax())
        cut_at = float((p[order[k]] + p[order[min(k + 1, n - 1)]]) / 2)
    return weights, out, cut_at


def _telling(counts: DataFrame, n: Column, one: Column, total: int, toxic: int, most: int) -> np.ndarray:
    """The buckets whose frequency differs most, in standard deviations, between toxic and other rows."""
    if not 0 < toxic < total:
        return np.zeros(0, np.int32)
    p = (n + 1) / F.lit(total + 2.0)
    z = F.abs(one / F.lit(float(toxic)) - (n - one) / F.lit(float(total - toxic))) / F.sqrt(p * (1 - p) * F.lit(1 / toxic + 1 / (total - toxic)))
    got = counts.select("b", F.round(z, 9).alias("z"), n.alias("n")).filter("n >= 3 and z > 0").orderBy(F.desc("z"), "b").limit(most)
    return np.sort(np.array([r.b for r in got.collect()], np.int32))  # most rows


def train(docs: DataFrame, labels: DataFrame, number: int, sample: int) -> Chain:
    rows = labelled(docs, labels, "toxic", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = buckets(b.column("text"))
            ends = np.cumsum([0, *map(len, own)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *own])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic").cast(pa.int32()), b.column("fold"), lists], ["doc_id", "toxic", "fold", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    held = cut(rows.select("doc_id", "toxic", fold, "text").mapInArrow(run, f"doc_id {kind}, toxic int, fold int, b array<int>"), "toxic-sample")
    # how many rows, and toxic ones, of each fold hold each of the 2**BITS buckets
    each = [f(F.col("fold") == i).alias(f"{name}{i}") for i in range(FOLDS) for name, f in (("n", F.count_if), ("t", lambda x: F.count_if(x & (F.col("toxic") == 1))))]
    counts = cut(held.select("toxic", "fold", F.explode("b").alias("b")).groupBy("b").agg(*each), "toxic-counts")
    size = held.agg(*each).first()
    sets = []
    for left_out in (None, *range(FOLDS)):
        use = [i for i in range(FOLDS) if i != left_out]
        add = lambda name, use=use: sum((F.col(f"{name}{i}") for i in use), F.lit(0))
        sets.append(_telling(counts, add("n"), add("t"), sum(size[f"n{i}"] for i in use), sum(size[f"t{i}"] for i in use), MARKERS))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(x.values) if x.as_py() else np.zeros(0, np.int32) for x in b.column("b")]
            bits = [[np.packbits(np.isin(m, r)).tobytes() for m in sets] for r in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("fold"), pa.array(bits, pa.list_(pa.binary()))], ["doc_id", "toxic", "fold", "bits"])

    got = held.mapInArrow(marked, f"doc_id {kind}, toxic int, fold int, bits array<binary>").orderBy("doc_id", "toxic", "bits").toArrow()  # sample rows at most, of some hundred bytes
    toxic = got.column("toxic").to_numpy().astype(float)
    bits = got.column("bits").to_pylist()
    x, *folds = [np.array([np.unpackbits(np.frombuffer(r[j], np.uint8), count=len(m)) for r in bits], np.uint8).reshape(len(toxic), len(m)) for j, m in enumerate(sets)]
    one = np.flatnonzero(toxic == 1)
    # markers of toxic texts only: those that more of them hold than of others
    more = x[one].mean(0) > x[toxic == 0].mean(0) if 0 < len(one) < len(toxic) else np.zeros(x.shape[1], bool)
    of = kinds(x[one][:, more].astype(float), number)
    y = {}
    for k in range(number):
        y[f"kind{k + 1}"] = np.zeros(len(toxic))
        y[f"kind{k + 1}"][one[of == k]] = 1
    y["toxic"] = toxic
    weights, _, cut_at = fit(x, folds, got.column("fold").to_numpy(), y)
    return Chain(list(y), sets[0], weights, cut_at)


def toxicity(docs: DataFrame, labels: DataFrame, number: int = KINDS, parts: int = 5, part: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, probabilities p_kind1, ... of the `number` kinds, score (of toxicity), predicted.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; others and nulls are left
    out). Labels of held-out documents (crc32 of the id as text, mod parts, is
    part) are never read. A null or empty text has no words; repeated rows get
    equal scores; a score at the cut is toxic (ties); without labels of both
    sorts nothing tells texts apart; a text is read whole, the longest ones
    piece by piece; other columns are ignored; an empty table gives an empty
    result.
    """
    chain = train(docs, labels.filter(~held_out("doc_id", parts, part)), number, sample)
    names, at = [f"p_{n}" for n in chain.names[:-1]], chain.cut
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.predict(matrix(buckets(b.column("text")), chain.markers))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, np.ascontiguousarray(p.T))], ["doc_id", *names, "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {''.join(f'{n} double, ' for n in names)}score double")
    return out.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), *names, "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
