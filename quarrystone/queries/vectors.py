"""Vector queries over the embeddings; the metadata is {label}."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import ann, search
from ..operators.placement import Assignment, Placement, fan_out
from ..plans.filters import Typed
from . import query, shared_dir, table

D = 64


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), "label")


def probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: an embedding of the table."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def typed(df: DataFrame) -> Typed:
    return Typed(df.drop("values").schema)


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), *more)


_Q = "(select embedding::double[] from embeddings where vec_id = {0})"
_DOT = "list_dot_product(embedding::double[], q)"
_COS = "case when list_dot_product(embedding::double[], embedding::double[]) = 0 or list_dot_product(q, q) = 0 then 0 else list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) end"
_EUC = "-list_distance(embedding::double[], q)"


def exact_sql(score: str, where: str = "true", k: int = 10, more: str = "", q: int = 0) -> str:
    return f"""
with r as (select vec_id::varchar as id, label, {score} as s from (select *, {_Q.format(q)} as q from embeddings) where {where})
select id, round(s, 6) as score{more} from r order by s desc, id limit {k}
"""


for _metric, _sql in (("cosine", _COS), ("dot", _DOT), ("euclidean", _EUC)):

    def _run(spark, sf_dir, metric=_metric):
        return out(search.exact(rows(spark, sf_dir), probe(spark, sf_dir), 10, metric))

    query(f"vec_exact_{_metric}", exact_sql(_sql))(_run)


@query("vec_exact_filtered", exact_sql(_COS, "label in (1, 2, 3) and label <> 2", more=", label"))
def vec_exact_filtered(spark, sf_dir):
    r = rows(spark, sf_dir)
    where = ["And", ["label", "In", [1, 2, 3]], ["Not", ["label", "Eq", 2]]]
    return out(search.exact(r, probe(spark, sf_dir), 10, "cosine", where, typed(r)), "label")


@query("vec_auto_small_corpus", exact_sql(_DOT, k=25, q=7))
def vec_auto_small_corpus(spark, sf_dir):
    """The table counts as a small corpus whatever its size, so auto answers exactly, as the SQL does."""
    r = rows(spark, sf_dir)
    q = probe(spark, sf_dir, 7)
    return out(ann.query(ann.build(r, D, "dot"), r, q, 25, "dot", small=r.count())[0])


@query(
    "vec_batch_topk",
    """
with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id::varchar as id, list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) as s from embeddings, q),
r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s)
select query_id, id, round(s, 6) as score, rank::integer as rank from r where rank <= 5
""",
)
def vec_batch_topk(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = search.batch(rows(spark, sf_dir), q, 5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "vec_multi_query",
    f"with a as ({exact_sql(_COS)}), b as ({exact_sql(_DOT, 'label = 3', 5, q=1)}) select id, score, 0 as query_index from a union all select id, score, 1 from b",
)
def vec_multi_query(spark, sf_dir):
    r = rows(spark, sf_dir)
    a = search.exact(r, probe(spark, sf_dir), 10)
    b = search.exact(r, probe(spark, sf_dir, 1), 5, "dot", ["label", "Eq", 3], typed(r))
    return search.multi([out(a), out(b)])


@query("vec_zero_norm", "select vec_id::varchar as id, 0.0::double as score from embeddings order by vec_id::varchar limit 10")
def vec_zero_norm(spark, sf_dir):
    return out(search.exact(rows(spark, sf_dir), [0.0] * D, 10))


@query(
    "project_attributes",
    f"with r as (select vec_id::varchar as id, label, {_COS} as s from (select *, {_Q.format(0)} as q from embeddings)) select id, round(-s, 6) as dist, label from r order by s desc, id limit 10",
)
def project_attributes(spark, sf_dir):
    got = search.project(search.exact(rows(spark, sf_dir), probe(spark, sf_dir), 10), ["vector", "label"], True, ["vector"])
    return got.select("id", F.round("$dist", 6).alias("dist"), "label")


@query("fetch_by_ids", "select vec_id::varchar as id, label, list_sum(embedding::double[]).round(6) as total from embeddings where vec_id in (3, 1, 42)")
def fetch_by_ids(spark, sf_dir):
    got = search.fetch(rows(spark, sf_dir), [" 3", "1", "42", "3", "none"])
    return got.select("id", "label", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(
    "sign_signature",
    "select vec_id::varchar as id, list_sum(list_transform(range(64), lambda i: case when embedding[i + 1] >= 0 then 1 else 0 end))::integer as ones, list_sum(list_transform(range(32), lambda i: case when embedding[i + 1] >= 0 then 1::bigint << i::integer else 0 end))::bigint as low from embeddings",
)
def sign_signature(spark, sf_dir):
    s = rows(spark, sf_dir).select("id", F.get(vector.signature(F.col("values"), D), F.lit(0)).alias("w"))
    return s.select("id", F.bit_count("w").alias("ones"), F.col("w").bitwiseAND(F.lit((1 << 32) - 1)).alias("low"))


@query(
    "hamming_rank",
    f"""
with q as (select {_Q.format(0)} as q),
h as (select vec_id::varchar as id, list_sum(list_transform(range(64), lambda i: case when (embedding[i + 1] >= 0) <> (q[i + 1] >= 0) then 1 else 0 end))::integer as h from embeddings, q)
select id, h as hamming, round((64 - 2 * h) / 64.0::double, 6) as score from h order by h, id limit 20
""",
)
def hamming_rank(spark, sf_dir):
    q = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    r = rows(spark, sf_dir).withColumn("hamming", vector.hamming(vector.signature(F.col("values"), D), vector.signature(q, D)))
    got = search.top(r.withColumn("score", vector.quantised("cosine", F.col("hamming"), D)), 20)
    return out(got, "hamming")


@query(
    "kmeans_assign",
    """
with c as (select vec_id as c, embedding::double[] as m from embeddings where vec_id < 8),
s as (select vec_id::varchar as id, c, list_dot_product(embedding::double[], m) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(m, m))) as s from embeddings, c),
r as (select *, row_number() over (partition by id order by round(s, 12) desc, c) as n from s)
select id, c::integer as bucket from r where n = 1
""",
)
def kmeans_assign(spark, sf_dir):
    seeds = table(spark, sf_dir, "embeddings").filter("vec_id < 8").orderBy("vec_id").collect()
    return ann.assign(rows(spark, sf_dir), np.array([s.embedding for s in seeds], float), "cosine").select("id", "bucket")


@query(
    "centroid_means",
    """
with c as (select vec_id as c, embedding::double[] as m from embeddings where vec_id < 8),
s as (select vec_id, embedding, c, -list_distance(embedding::double[], m) as s from embeddings, c),
r as (select *, row_number() over (partition by vec_id order by round(s, 12) desc, c) as n from s)
select c::integer as bucket, i::integer as i, round(avg(x), 6) as mean from (select c, unnest(range(64)) as i, unnest(embedding::double[]) as x from r where n = 1) group by c, i
""",
)
def centroid_means(spark, sf_dir):
    """One Lloyd round from the first eight embeddings."""
    seeds = table(spark, sf_dir, "embeddings").filter("vec_id < 8").orderBy("vec_id").collect()
    means = ann._moved(rows(spark, sf_dir), np.array([s.embedding for s in seeds], float), "euclidean")
    got = spark.createDataFrame([(i, [float(x) for x in m]) for i, m in enumerate(means)], "bucket int, m array<double>")
    return got.select("bucket", F.posexplode("m").alias("i", "mean")).select("bucket", "i", F.round("mean", 6).alias("mean"))


@query("vec_squared_euclidean", exact_sql(f"-pow({_EUC}, 2)", k=10))
def vec_squared_euclidean(spark, sf_dir):
    r = rows(spark, sf_dir)
    return out(search.top(r.withColumn("score", vector.squared_euclidean(F.col("values"), probe(spark, sf_dir))), 10))


_SHARD = "(('0x' || substr(sha256('embeddings' || chr(31) || 'default' || chr(31) || vec_id::varchar), 1, 16))::ubigint % 4)::integer"


def sharded(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.withColumn("shard", text.shard_of("embeddings", "default", F.col("id"), 4))


@query(
    "shard_assignment",
    f"select vec_id::varchar as id, {_SHARD} as shard, 'default__tvs' || lpad({_SHARD}::varchar, 4, '0') as namespace from embeddings",
)
def shard_assignment(spark, sf_dir):
    return sharded(spark, sf_dir).select("id", "shard", text.shard_namespace(F.lit("default"), F.col("shard")).alias("namespace"))


@query("shard_merge_topk", exact_sql(_DOT, k=10))
def shard_merge_topk(spark, sf_dir):
    r, q = sharded(spark, sf_dir), probe(spark, sf_dir)
    parts = search.ranked(r.withColumn("score", vector.score("dot", F.col("values"), q)), ["shard"], 10)
    return out(search.merge_shards(parts, 10))


@query("shard_degraded", exact_sql(_DOT, f"{_SHARD} <> 2", 10))
def shard_degraded(spark, sf_dir):
    q = probe(spark, sf_dir)
    nodes = tuple(Assignment(i, "n", "offline" if i == 2 else "draining" if i == 1 else "active") for i in range(4))
    best = lambda r: search.ranked(r.withColumn("score", vector.score("dot", F.col("values"), q)), ["shard"], 10)
    return out(fan_out(Placement("embeddings", 1, 4, nodes), sharded(spark, sf_dir), best, 10)[0])


def circle(spark: SparkSession, n: int = 20_800) -> DataFrame:
    """Generated vectors, enough for real buckets: 8 waves of a row's number, and metadata {cohort}."""
    i = F.col("i")
    waves = [F.cos(i * (0.013 * (j + 1)) + j * 0.7) * (1.0 + 0.1 * j) for j in range(8)]
    r = spark.range(n).withColumnRenamed("id", "i")
    return r.select(F.format_string("doc-%05d", "i").alias("id"), F.array(*[w.cast("float") for w in waves]).alias("values"), F.when(i % 61 == 0, "b").otherwise("a").alias("cohort"), "i")


def _recall(spark: SparkSession, r: DataFrame, index, k: int = 10) -> DataFrame:
    """For each row whose number (column i) is divisible by 50, how many of its k closest rows the index finds."""
    queries = r.filter(F.col("i") % 50 == 0).select(F.col("i").alias("query_id"), F.col("values").cast("array<double>").alias("q"))
    near = ann.batch(index, queries, k, small=0).select("query_id", "id", F.lit(1).alias("found"))
    true = search.batch(r, queries, k, index.metric).select("query_id", "id")
    return true.join(near, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("found") / F.count(F.lit(1))).alias("recall"))


def _stored(spark: SparkSession, r: DataFrame, dimension: int, **options) -> ann.AnnIndex:
    return ann.build(r, dimension, **options).save(f"{shared_dir(spark)}/ann-{uuid.uuid4().hex}")


@query("ann_recall")
def ann_recall(spark, sf_dir):
    """On the embeddings, with a bucket for about 16 rows."""
    r = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("i"))
    return _recall(spark, r, _stored(spark, r, D, buckets=max(8, r.count() // 16), least=1))


_kept: dict[str, tuple[ann.AnnIndex, DataFrame]] = {}


def large(spark: SparkSession) -> tuple[ann.AnnIndex, DataFrame]:
    """The generated vectors as a table, and their stored index; written once a session."""
    key = spark.sparkContext.applicationId
    if key not in _kept:
        path = f"{shared_dir(spark)}/circle-{uuid.uuid4().hex}"
        circle(spark).write.parquet(path)
        r = spark.read.parquet(path)
        _kept[key] = (_stored(spark, r, 8), r)
    return _kept[key]


@query("ann_recall_generated")
def ann_recall_generated(spark, sf_dir):
    index, r = large(spark)
    return _recall(spark, r, index)


def _asked(r: DataFrame) -> list[float]:
    return list(r.filter("i = 7300").first()["values"])


@query("ann_large")
def ann_large(spark, sf_dir):
    index, r = large(spark)
    return out(ann.query(index, r, _asked(r), 10)[0], "cohort")


@query("exact_large")
def exact_large(spark, sf_dir):
    """What ann_large is measured against."""
    _, r = large(spark)
    return out(search.exact(r, _asked(r), 10), "cohort")


@query("ann_filtered_generated")
def ann_filtered_generated(spark, sf_dir):
    """A cohort of every 61st row: candidates are widened until there are enough of it."""
    index, r = large(spark)
    return out(ann.query(index, r, _asked(r), 10, where=["cohort", "Eq", "b"], backend=Typed(r.drop("values").schema))[0], "cohort")


@query("ann_probe_all", exact_sql(_COS, k=10))
def ann_probe_all(spark, sf_dir):
    """As many buckets as are probed in any case, and all rows reranked: the stored index then answers exactly."""
    r = rows(spark, sf_dir)
    n = r.count()
    got, note = ann.query(_stored(spark, r, D, buckets=16, least=1), r, probe(spark, sf_dir), 10, small=0, rerank=n)
    assert note["path"] == "ann" and note["probes"] == 16
    return out(got)
