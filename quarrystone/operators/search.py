"""Exact vector search, top-k and projections."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..functions import vector
from ..plans.filters import Backend, compile_filter
from .matrix import CELLS, cuts, matrix, paired, scores


def check_vector(values: Sequence[float], dimension: int | None = None) -> list[float]:
    out = [float(x) for x in values]
    if not out or not all(map(math.isfinite, out)):
        raise InvalidArgument("a vector needs finite numbers")
    if dimension is not None and len(out) != dimension:
        raise InvalidArgument(f"the vector has {len(out)} elements; the collection has {dimension}")
    return out


def check_top_k(k: int, most: int | None = None) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or most is not None and k > most:
        raise InvalidArgument(f"top_k is a whole number from 1{f' to {most}' if most else ''}")
    return k


def namespace_limit(limit: int | dict) -> int:
    """The namespace API's limit: a number, or {"total": n, "per": ...}, of which per is ignored."""
    return check_top_k(limit.get("total") if isinstance(limit, dict) else limit, 10_000)


def top(df: DataFrame, k: int, tie: str | Column = "id") -> DataFrame:
    """Best scores first, ties by id: TakeOrderedAndProject keeps k rows a task."""
    return df.orderBy(F.desc("score"), tie).limit(check_top_k(k))


def exact(rows: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", where: Any = None, backend: Backend | None = None, values: str = "values") -> DataFrame:
    """rows: id, values and metadata -> the k closest rows with score. Filters run before scores."""
    q = check_vector(query)
    kept = rows if where is None else rows.filter(compile_filter(where, backend))
    return top(kept.withColumn("score", vector.score(metric, F.col(values), q)), k)


class _Best:
    """The k best rows of each of some queries among the vectors seen so far, ties by id.

    Scores are taken in slices of rows and queries, and what is held is cut to
    k rows a query whenever it grows, so memory is bounded by the queries.
    """

    def __init__(self, own: np.ndarray, k: int, metric: str, most: int = CELLS):
        self.own, self.k, self.metric, self.most = own, k, metric, most
        self.least = np.full(len(own), -np.inf)  # scores below it aren't among the k best
        self.held, self.n = [], 0

    def see(self, v: np.ndarray, ids: pa.Array) -> None:
        wide = min(len(self.own), 1024)
        for r in cuts(len(v), max(1, self.most // wide)):
            for c in cuts(len(self.own), wide):
                s, k = scores(self.metric, v[r], self.own[c]), self.k
                least = self.least[c]
                if len(s) >= k:
                    kth = np.partition(s, -k, axis=0)[-k]
                    least = np.maximum(least, kth - 1e-9 * (1 + np.abs(kth)))
                i, j = np.nonzero(s >= least)
                # scored anew, each for itself, so that ties are real ones
                for x in cuts(len(i), max(1, self.most // v.shape[1])):
                    at, q = i[x] + r.start, j[x] + c.start
                    self.held.append(pa.table({"q": q.astype(np.int32), "score": paired(self.metric, v[at], self.own[q]), "id": ids.take(pa.array(at))}))
                    self.n += len(at)
                    if self.n > self.most + 2 * self.k * len(self.own):
                        self.table()

    def table(self) -> pa.Table | None:
        """What is held, cut to the k best of each query."""
        if self.held:
            all_ = pa.concat_tables(self.held)
            all_ = all_.take(pc.sort_indices(all_, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")).combine_chunks()
            q = all_.column("q").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = all_.column("score").to_numpy()[place == self.k - 1]
            last = -last * last if self.metric == "euclidean" else last  # scores() has squares
            self.least[q[place == self.k - 1]] = last - 1e-9 * (1 + np.abs(last))
            self.held = [all_.filter(pa.array(place < self.k))]
            self.n = len(self.held[0])
        return self.held[0] if self.held else None


def batch(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", block: int = 8192) -> DataFrame:
    """query_id, id, score, rank: the k closest rows of each query. queries: query_id, q (a stated set, sent to the tasks in blocks of `block`).

    A block is one pass over the rows: they meet all its queries in matrix
    products, and a task passes on the k best of each query. A rank over what is
    left follows. Vectors that are null, not finite or of another dimension are
    left out.
    """
    check_top_k(k)
    kind = rows.schema["id"].dataType.simpleString()
    form = f"query_id long, id {kind}, score double"
    stated = queries.orderBy("query_id").toLocalIterator()
    out = None
    while part := list(islice(stated, block)):
        own = np.array([check_vector(r.q, len(part[0].q)) for r in part])
        names = np.array([r.query_id for r in part], np.int64)

        def run(batches: Iterator[pa.RecordBatch], own: np.ndarray = own, names: np.ndarray = names) -> Iterator[pa.RecordBatch]:
            best = _Best(own, k, metric)
            for x in batches:
                at, v = matrix(x.column("values"), own.shape[1])
                best.see(v, x.column("id").take(pa.array(at)))
            if (got := best.table()) is not None:
                got = pa.table([pa.array(names[got.column("q").to_numpy()]), got.column("id"), got.column("score")], ["query_id", "id", "score"])
                yield from got.to_batches(max_chunksize=10_000)

        best = ranked(rows.select("id", "values").mapInArrow(run, form), ["query_id"], k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"{form}, rank int")


def ranked(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def multi(parts: list[DataFrame]) -> DataFrame:
    """Results of at most 16 queries, told apart by query_index."""
    if not 1 <= len(parts) <= 16:
        raise InvalidArgument("multiQuery takes 1 to 16 queries")
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("query_index", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def merge_shards(parts: DataFrame, k: int) -> DataFrame:
    """Top k over all shards; of rows with one id the best stays."""
    w = Window.partitionBy("id").orderBy(F.desc("score"))
    return top(parts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"), k)


def project(result: DataFrame, attributes: Sequence[str], include: bool | Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """id and $dist always; attributes ("vector" is one) as included and not excluded."""
    if include is True or include is None:
        wanted = list(attributes)
    else:
        wanted = [a for a in attributes if include and a in include]
    names = [a for a in wanted if a not in exclude]
    return result.select("id", (-F.col("score")).alias("$dist"), *[F.col("values").alias("vector") if a == "vector" else F.col(f"`{a}`") for a in names])


def fetch(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows by id, in the order of the request; blanks are trimmed, repeats and missing ids skipped."""
    wanted = list(dict.fromkeys(i.strip() for i in ids))
    if not wanted or not all(wanted):
        raise InvalidArgument("ids must not be blank")
    ask = rows.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, id string")
    return rows.join(F.broadcast(ask), "id").orderBy("pos").drop("pos")  # the request's own size bounds it
