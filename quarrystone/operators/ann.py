"""Approximate search: buckets by k-means, one-bit signatures, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector
from ..plans import budget as b
from ..plans.filters import Backend, compile_filter, parse
from .filter_index import FilterIndex, safe
from .matrix import CELLS, cuts, matrix, nearest, scores
from .search import check_vector, exact, ranked, top


#: Rows of a bucket in one file, at most, when an index is saved.
ROWS_A_FILE = 1_000_000


@dataclass
class AnnIndex:
    """rows: id, values, norm, signature, bucket and metadata; centroids live on the driver.

    A saved index is one Parquet folder a bucket, so a query's buckets are a
    partition filter: the others' files aren't opened.
    """

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    roots: list[np.ndarray]
    metric: str
    dimension: int
    filters: FilterIndex | None = None

    def save(self, path: str) -> AnnIndex:
        """Writes rows by bucket, then centroids and sizes; returns the index as stored."""
        self.rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(-(-int(self.sizes.max()) // ROWS_A_FILE)))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        facts = [(i, [float(x) for x in c], int(n), self.metric, self.dimension) for i, (c, n) in enumerate(zip(self.centroids, self.sizes, strict=True))]
        self.rows.sparkSession.createDataFrame(facts, "bucket int, centroid array<double>, size long, metric string, dimension int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        made = AnnIndex.load(self.rows.sparkSession, path, False)
        if made._described():
            FilterIndex.build(made.rows).save(f"{path}/filters")
        return AnnIndex.load(self.rows.sparkSession, path)

    def _described(self) -> bool:
        return dict(self.rows.dtypes).get("metadata") == "variant"

    @staticmethod
    def load(spark: SparkSession, path: str, whole: bool = True) -> AnnIndex:
        facts = spark.read.parquet(f"{path}/centroids").orderBy("bucket").collect()  # a row for each bucket
        centroids, sizes = np.array([r.centroid for r in facts]), np.array([r["size"] for r in facts])
        metric = facts[0].metric
        out = AnnIndex(spark.read.parquet(f"{path}/rows"), centroids, sizes, group(centroids, metric, b.root_count(len(facts))), metric, facts[0].dimension)
        if whole and out._described():
            out.filters = FilterIndex.load(spark, f"{path}/filters", {i: int(n) for i, n in enumerate(sizes)})
        return out

    @property
    def vectors(self) -> int:
        return int(self.sizes.sum())

    def probe(self, q: np.ndarray, beam: int, probes: int, among: set[int] | None = None) -> list[int]:
        """The best `beam` roots' buckets, best first, then all others until the budget is met. among: no others."""
        return self.probes(q[None], beam, probes, among)[0]

    def probes(self, qs: np.ndarray, beam: int, probes: int, among: set[int] | None = None) -> list[list[int]]:
        """probe() for many queries, a slice of them at a time."""
        means = np.stack([self.centroids[r].mean(0) for r in self.roots])
        allowed = None if among is None else np.array(sorted(among), np.int64)
        out = []
        for x in cuts(len(qs), max(1, CELLS // len(self.centroids))):
            orders, leaves = np.argsort(-scores(self.metric, qs[x], means), axis=1, kind="stable"), scores(self.metric, qs[x], self.centroids)
            for order, leaf in zip(orders, leaves, strict=True):
                got: list[int] = []
                for roots in (order[:beam], order[beam:]):
                    if len(roots) and len(got) < probes:  # others are looked at only if these are too few
                        ids = np.concatenate([self.roots[r] for r in roots])
                        ids = ids if allowed is None else ids[np.isin(ids, allowed)]
                        got += ids[np.lexsort((ids, -leaf[ids]))].tolist()
                out.append(got[:probes])
        return out


def group(centroids: np.ndarray, metric: str, n: int, rounds: int = 8) -> list[np.ndarray]:
    """The roots of the two-level tree: centroids grouped by a few k-means rounds, so that a root's leaves lie together."""
    means = centroids[np.linspace(0, len(centroids) - 1, n).astype(int)]
    for _ in range(rounds):
        own = scores(metric, centroids, means).argmax(1)
        means = np.stack([centroids[own == i].mean(0) if (own == i).any() else means[i] for i in range(n)])
    own = scores(metric, centroids, means).argmax(1)
    return [x for i in range(n) if len(x := np.flatnonzero(own == i))]


def assign(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """bucket: the nearest centroid, of equal ones the first; null for vectors that are null, of another dimension or not finite.

    Matrix products over Arrow batches, so each row meets all centroids in place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at, v = matrix(x.column("values"), centroids.shape[1])
            best = np.zeros(x.num_rows, np.int32)
            best[at] = nearest(metric, v, centroids)
            none = np.ones(x.num_rows, bool)
            none[at] = False
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(best, mask=none)], [*x.schema.names, "bucket"])

    return rows.mapInArrow(run, f"{rows.schema.simpleString()[7:-1]}, bucket int")


def _moved(rows: DataFrame, centroids: np.ndarray, metric: str) -> np.ndarray:
    """One Lloyd round: the means of the rows that are nearest to each centroid. A task sums a vector for each bucket; nothing else is shuffled."""
    k, d = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, d)), np.zeros(k, np.int64)
        for x in batches:
            _, v = matrix(x.column("values"), d)
            if len(v):
                best = nearest(metric, v, centroids)
                np.add.at(total, best, v)
                n += np.bincount(best, minlength=k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["bucket", "n", "s"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for x in batches:
            for i, n, s in zip(x.column("bucket").to_pylist(), x.column("n").to_pylist(), x.column("s"), strict=True):
                own = total.setdefault(i, [0, np.zeros(d)])
                own[0] += n
                own[1] = own[1] + s.values.to_numpy()
        at = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i][0] for i in at], pa.int64()), pa.array([total[i][1] for i in at], pa.list_(pa.float64()))], ["bucket", "n", "s"])

    form = "bucket int, n long, s array<double>"
    out = centroids.copy()
    for r in rows.select("values").mapInArrow(summed, form).repartition("bucket").mapInArrow(added, form).collect():  # a row for each bucket
        out[r.bucket] = np.array(r.s) / r.n
    return out


def build(rows: DataFrame, dimension: int, metric: str = "cosine", rounds: int = 2, buckets: int | None = None, least: int = b.MIN_VECTORS) -> AnnIndex | None:
    """rows: id, values and metadata. None below `least` vectors; rows without a usable vector are left out.

    Centroids start from rows that are evenly spaced in id order (taken by a
    distributed sort); a Lloyd round assigns rows by the metric and averages
    them. buckets: by default the square root of the number of rows, at most
    256; more for collections of many millions, as a query reads whole buckets.
    """
    n = rows.count()
    if n < least:
        return None
    k = min(n, buckets or b.bucket_count(n))
    base = rows.withColumn("norm", vector.norm(F.col("values"))).withColumn("signature", vector.signature(F.col("values"), dimension))
    # every (n/k)-th row in id order: counts of range partitions give each its first rank
    parts = base.filter(F.size("values") == dimension).select("id", "values").repartitionByRange(max(1, n // 200_000 + 1), "id").withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("id")))
    parts = parts.persist()
    held, starts = 0, {}
    for r in parts.groupBy("_p").count().orderBy("_p").collect():
        starts[r._p] = held
        held += r["count"]
    if not held:
        parts.unpersist()
        return None
    offset = F.element_at(F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s))]), F.col("_p"))
    k = min(k, held)
    # rank r is i * held // k of an i below k: the least i that doesn't fall below r meets it
    placed = parts.withColumn("_r", F.col("_r") - 1 + offset).withColumn("_i", F.expr(f"(_r * {k}L + {held - 1}L) div {held}L"))
    seeds = placed.filter(f"_i < {k} and (_i * {held}L) div {k}L = _r").orderBy("id").select("values").collect()  # a row for each bucket
    parts.unpersist()
    centroids = np.array([r["values"] for r in seeds], float)
    for _ in range(rounds):
        centroids = _moved(base, centroids, metric)
    done = assign(base, centroids, metric).filter("bucket is not null")
    sizes = np.zeros(len(centroids), np.int64)
    for r in done.groupBy("bucket").count().collect():
        sizes[r.bucket] = r["count"]
    return AnnIndex(done, centroids, sizes, group(centroids, metric, b.root_count(len(centroids))), metric, dimension)


def refused(index: AnnIndex | None, dimension: int, metric: str) -> str | None:
    """Why an index can't answer, or null."""
    return "insufficient_vectors" if index is None else "dimension_mismatch" if index.dimension != dimension else "metric_mismatch" if index.metric != metric else None


def query(index: AnnIndex | None, rows: DataFrame, values: Sequence[float], k: int = 10, metric: str = "cosine", where: Any = None, backend: Backend | None = None, strategy: str = "auto", beam: int = 4, widen: int = 4, expected: int | None = None, small: int = b.SMALL, rerank: int = b.RERANK_LEAST, reads: int = b.READS) -> tuple[DataFrame, dict]:
    """The k closest rows and how they were found.

    strategy auto and ann use the index; small corpora, and any failure to use
    it, go to the exact search, with the reason. Of a saved index only the
    probed buckets are read; within the budget the best by signature are
    candidates; those are scored exactly, `rerank` of them at least. A query
    whose buckets are more than `reads` files is answered exactly.
    """
    q = np.array(check_vector(values))
    note: dict = {"path": "exact", "fallback_reasons": []}
    plain = lambda: exact(rows, values, k, metric, where, backend)
    if strategy == "exact":
        return plain(), note
    reason = refused(index, len(q), metric)
    if reason:
        return plain(), note | {"path": "ann_fallback", "fallback_reasons": [reason]}
    if index.vectors <= small:
        return plain(), note | {"path": "ann", "small_corpus": True}
    keep = compile_filter(where, backend)
    among = None
    if where is not None and index.filters is not None:
        per = index.filters.matches(where)
        expected = sum(per.values()) if expected is None else expected
        among = set(per) if safe(parse(where)) else None
    elif where is not None and expected is None:
        expected = index.rows.filter(keep).count()  # reads the metadata columns only
    plan = b.budget(k, index.vectors, len(index.centroids), where is not None, expected, small)
    probes = plan.probes
    bits = (q >= 0).astype(np.uint64)
    signature = F.array(*[F.lit(int((bits[w : w + 64] << np.arange(len(bits[w : w + 64]), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))) for w in range(0, len(q), 64)])
    for attempt in range(widen + 1):
        chosen = index.probe(q, beam, probes, among)
        near = index.rows.filter(F.col("bucket").isin(*chosen)).filter(keep)
        if where is None or attempt == widen or probes >= len(index.centroids if among is None else among) or near.select("id").limit(k).count() >= k:
            break
        probes = min(len(index.centroids), probes * 2)
    if int(np.ceil(index.sizes[chosen] / ROWS_A_FILE).sum()) > reads:
        return plain(), note | {"path": "ann_fallback", "fallback_reasons": ["read_budget_exceeded"]}
    held = min(int(index.sizes[chosen].sum()), max(plan.candidates, rerank))
    limit = max(b.rerank_limit(k, held), min(held, rerank))
    # short signatures tie often: of equal ones the rows of nearer buckets come first
    first = near.withColumn("score", vector.quantised(metric, vector.hamming(F.col("signature"), signature), index.dimension))
    nearer = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("bucket"))
    found = first.orderBy(F.desc("score"), nearer, "id").limit(limit).drop("score")
    note |= {"path": "ann", "probes": len(chosen), "rerank": limit, "candidates": plan.candidates}
    return top(found.withColumn("score", vector.score(metric, F.col("values"), values, F.col("norm"))), k), note


def batch(index: AnnIndex, queries: DataFrame, k: int = 10, beam: int = 4, block: int = 8192, small: int = b.SMALL) -> DataFrame:
    """query_id, id, score, rank: the k closest rows of each query among the buckets it probes, scored exactly.

    queries: query_id, q (a stated set, sent to the tasks in blocks). Rows meet
    the queries that probe their bucket, so a block is one pass over the
    buckets that any of them probes.
    """
    stated = queries.orderBy("query_id").toLocalIterator()
    spark, out = index.rows.sparkSession, None
    probes = b.budget(k, index.vectors, len(index.centroids), small=small).probes
    while part := list(islice(stated, block)):
        own = np.array([check_vector(r.q, index.dimension) for r in part])
        chosen = index.probes(own, beam, probes)
        places = np.repeat(np.arange(len(part)), [len(x) for x in chosen])
        pairs = spark.createDataFrame(pa.table({"bucket": pa.array(np.concatenate(chosen), pa.int32()), "place": pa.array(places, pa.int32())}))
        asked = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(part)), pa.int32()), "query_id": pa.array([r.query_id for r in part], pa.int64()), "q": pa.array(list(own), pa.list_(pa.float64()))}))
        buckets = sorted({x for c in chosen for x in c})
        near = index.rows
        if len(buckets) < len(index.centroids):
            near = near.filter(f"bucket in ({', '.join(map(str, buckets))})")
        near = near.select("bucket", "id", "values", "norm").join(F.broadcast(pairs), "bucket").join(F.broadcast(asked), "place")  # a block of queries, and what each of them probes
        best = ranked(near.select("query_id", "id", vector.score(index.metric, F.col("values"), F.col("q"), F.col("norm")).alias("score")), ["query_id"], k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "query_id long, id string, score double, rank int")


def merged(notes: list[dict]) -> dict:
    """What the searches of several shards say together: numbers are summed, reasons united; a fallback of one is one of all."""
    out: dict = {"path": "exact", "fallback_reasons": sorted({r for n in notes for r in n.get("fallback_reasons", [])})}
    paths = {n["path"] for n in notes}
    out["path"] = next((p for p in ("ann_fallback", "ann") if p in paths), "exact")
    for name in ("probes", "rerank", "candidates"):
        if any(name in n for n in notes):
            out[name] = sum(n.get(name, 0) for n in notes)
    if any(n.get("small_corpus") for n in notes):
        out["small_corpus"] = True
    return out
