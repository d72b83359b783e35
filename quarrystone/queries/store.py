"""Queries over the segment log, the catalog and the write queue; events replayed by ts stand for writes, `error` for deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.placement import Assignment, Placement, rebalance
from ..sources.segments import visible
from ..sources.store import Store
from ..streaming.queue import summary
from ..streaming.writes import stream_into
from . import query, shared_dir, spread, table

def _micros():
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("default").alias("namespace"),
        _micros().alias("seg_seq"),
        F.col("event_id").alias("row_seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("user_id").cast("string").alias("id"),
        "value",
        "event_type",
    )


_LAST = "select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events {0}) where n = 1 and event_type <> 'error'"


@query("snapshot_replay", f"select user_id::varchar as id, value, event_type from ({_LAST.format('')})")
def snapshot_replay(spark, sf_dir):
    return visible(log(spark, sf_dir)).select("id", "value", "event_type")


def _with(l, spark, sf_dir, rows):
    """The log and one more segment of rows (op, id)."""
    return l.unionByName(rows.select(F.lit("default").alias("namespace"), F.lit(1 << 62).alias("seg_seq"), F.lit(0).cast("long").alias("row_seq"), "op", "id", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("event_type")))


@query("delete_ids", f"select user_id::varchar as id, value from ({_LAST.format('')}) where user_id % 3 <> 0")
def delete_ids(spark, sf_dir):
    l = log(spark, sf_dir)
    gone = l.filter("cast(id as long) % 3 = 0").select("id").distinct().withColumn("op", F.lit("delete"))
    return visible(_with(l, spark, sf_dir, gone)).select("id", "value")


@query("delete_filter", f"select user_id::varchar as id, value from ({_LAST.format('')}) where not value >= 50")
def delete_filter(spark, sf_dir):
    l = log(spark, sf_dir).withColumn("metadata", F.to_variant_object(F.struct("value"))).withColumn("delete_filter", F.lit(None).cast("string"))
    one = l.limit(1).select("namespace", F.lit(1 << 62).alias("seg_seq"), F.lit(0).cast("long").alias("row_seq"), F.lit("delete_filter").alias("op"), F.lit(None).cast("string").alias("id"), "value", "event_type", "metadata", F.lit('["value", "Gte", 50]').alias("delete_filter"))
    return visible(l.unionByName(one)).select("id", "value")


@query("delete_all", f"select user_id::varchar as id, value from ({_LAST.format("where ts > (select quantile_disc(ts, 0.5) from events)")})")
def delete_all(spark, sf_dir):
    l = log(spark, sf_dir)
    middle = l.agg(F.expr("percentile_disc(0.5) within group (order by seg_seq)").alias("seg_seq"))
    clear = middle.select(F.lit("default").alias("namespace"), "seg_seq", F.lit(0).cast("long").alias("row_seq"), F.lit("delete_all").alias("op"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("event_type"))
    return visible(l.unionByName(clear)).select("id", "value")


def fresh_store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


_kept: dict[tuple, Store] = {}


def collection(spark, sf_dir, name: str) -> Store:
    """A store that holds a table as a collection, with its index, written once a session: embeddings (metadata {label}) or documents (metadata {body, lang, source})."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        store = fresh_store(spark)
        if name == "embeddings":
            store.create(name, 64, "cosine")
            rows = table(spark, sf_dir, name).select("vec_id", F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_variant_object(F.struct("label")).alias("metadata"))
        else:
            store.create(name, 1, "dot", {f: {"full_text_search": True} for f in ("body", "lang", "source")})
            rows = spread(table(spark, sf_dir, name)).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.array(F.lit(0.0).cast("float")).alias("values"), F.to_variant_object(F.struct(F.col("text").alias("body"), "lang", "source")).alias("metadata"))
        store.append(name, Store.upsert_frame(rows.withColumnRenamed(rows.columns[0], "row_seq")))
        store.ensure_texts(name)
        _kept[key] = store
    return _kept[key]


@query("collection_stats", "select count(*) as vector_count, 64 as dimension, 1 as segments, count(*) * 256 as approx_bytes from embeddings")
def collection_stats(spark, sf_dir):
    s = collection(spark, sf_dir, "embeddings").stats("embeddings")
    return spark.createDataFrame([(s["vector_count"], s["dimension"], s["segments"], s["approx_bytes"])], "vector_count long, dimension int, segments int, approx_bytes long")


@query("namespace_page", "select replace(n_name, ' ', '_') as name from nation where n_name like '%' and replace(n_name, ' ', '_') > 'C' order by 1 limit 10")
def namespace_page(spark, sf_dir):
    """The second page of collections, one for each nation."""
    store = fresh_store(spark)
    for r in table(spark, sf_dir, "nation").select("n_name").collect():  # a collection for each
        store.create(r.n_name.replace(" ", "_"), 2)
    return spark.createDataFrame([(x,) for x in store.page("", "C", 10)["namespaces"]], "name string")


@query("store_collections", "select replace(n_name, ' ', '_') as name, n_nationkey::integer + 1 as dimension from nation")
def store_collections(spark, sf_dir):
    store = fresh_store(spark)
    for r in table(spark, sf_dir, "nation").collect():  # a collection for each
        store.create(r.n_name.replace(" ", "_"), int(r.n_nationkey) + 1)
    return spark.createDataFrame([(c["name"], c["dimension"]) for c in store.collections()], "name string, dimension int")


@query("store_placement", "with n as (select r_name, row_number() over (order by r_name) - 1 as k, count(*) over () as c from region) select s::integer as shard_id, r_name as node_id, 'active' as state, 2::bigint as version from range(12) t(s) join n on s % c = k")
def store_placement(spark, sf_dir):
    """Twelve shards of one node, dealt out to a node for each region and stored."""
    store = fresh_store(spark)
    first = store.place("c", Placement("c", 1, 12, tuple(Assignment(i, "one") for i in range(12))), 0)
    store.place("c", rebalance(first, [r.r_name for r in table(spark, sf_dir, "region").collect()], True), first.version)
    now = store.placement("c")
    return spark.createDataFrame([(a.shard_id, a.node_id, a.state, now.version) for a in now.assignments], "shard_id int, node_id string, state string, version long")


@query("store_fetch", "select vec_id::varchar as id, label from embeddings where vec_id in (3, 1, 42)")
def store_fetch(spark, sf_dir):
    got = collection(spark, sf_dir, "embeddings").fetch("embeddings", [" 3", "1", "42", "3", "none"])
    return got.select("id", F.try_variant_get("metadata", "$.label", "int").alias("label"))


def _in_parts(rows, keys: list[str], parts: int) -> list:
    """Rows in the order of keys, in parts of equal sizes (as ntile makes them), each with row_seq, which ascends in that order.

    Ranges of keys are sorted each for itself, so no task holds all rows; the
    rows at which parts start are found by counts of the ranges.
    """
    n = rows.count()
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, n // 500_000 + 1)
    # the id is the number of a range (upper 31 bits) and of the row in it
    in_order = lambda df, name: df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
    part = F.lit(1)
    if parts > 1 and n:
        ordered = in_order(rows.select(*keys), "_at").persist()
        held, wanted, at = 0, [i * (n // parts) + min(i, n % parts) for i in range(1, parts)], []
        for r in ordered.groupBy(F.shiftright("_at", 33).alias("range")).count().orderBy("range").collect():  # a row for each range
            at += [(r.range << 33) + w - held for w in wanted if held <= w < held + r["count"]]
            held += r["count"]
        starts = ordered.filter(F.col("_at").isin(at)).select(*keys).collect()  # the first row of each part but one
        ordered.unpersist()
        for s in starts:
            part = part + F.when(F.struct(*keys) >= F.struct(*[F.lit(s[k]).alias(k) for k in keys]), 1).otherwise(0)
    return [in_order(rows.filter(part == i), "row_seq") for i in range(1, parts + 1)]


def _loaded(spark, sf_dir, segments: int = 1) -> Store:
    """Events as writes of a collection, in some segments by time."""
    store = fresh_store(spark)
    store.create("events", 1, "dot")
    rows = table(spark, sf_dir, "events").select(
        _micros().alias("us"),
        "event_id",
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value").cast("float")).alias("values"),
        F.to_variant_object(F.struct("value", "event_type")).alias("metadata"),
        F.lit(None).cast("string").alias("delete_filter"),
    )
    for part in _in_parts(rows, ["us", "event_id"], segments):
        store.append("events", part.drop("us", "event_id"))
    return store


def _values(got):
    return got.select("id", F.round(F.try_variant_get("metadata", "$.value", "double"), 6).alias("value"))


_FINAL = f"select user_id::varchar as id, round(value, 6) as value from ({_LAST.format('')})"


@query("store_delete_filter", f"{_FINAL} where not value >= 50")
def store_delete_filter(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    store.delete("events", where=["value", "Gte", 50])
    return _values(store.snapshot("events"))


@query("store_delete_ids", f"{_FINAL} where user_id % 3 <> 0")
def store_delete_ids(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    store.delete("events", ids=store.snapshot("events").filter("cast(id as long) % 3 = 0").select("id"))
    return _values(store.snapshot("events"))


@query("store_compact", _FINAL)
def store_compact(spark, sf_dir):
    """Four segments, made one."""
    store = _loaded(spark, sf_dir, 4)
    done = store.compact("events")
    assert len(done["segments"]) == 1
    return _values(store.snapshot("events"))


@query("store_sharded_write", "select shard, count(*) as n, sum(vec_id)::bigint as ids from (select *, (('0x' || substr(sha256('embeddings' || chr(31) || 'default' || chr(31) || vec_id::varchar), 1, 16))::ubigint % 4)::integer as shard from embeddings) group by shard")
def store_sharded_write(spark, sf_dir):
    store = fresh_store(spark)
    store.create("embeddings", 64)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_seq"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_variant_object(F.struct("label")).alias("metadata"))
    store.append_sharded("embeddings", Store.upsert_frame(rows), 4)
    got = store.snapshot("embeddings", [f"default__tvs{i:04d}" for i in range(4)])
    return got.groupBy(t.parse_shard_namespace(F.col("namespace"))[1].cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query("store_flush", "select n_name as id, n_regionkey as region from nation")
def store_flush(spark, sf_dir):
    """Writes of five rows each are accepted, then applied by one flush; a repeated one counts once."""
    store = fresh_store(spark)
    store.create("nation", 1, "dot")
    rows = [{"id": r.n_name, "values": [float(r.n_nationkey)], "metadata": {"region": r.n_regionkey}} for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    for i in range(0, len(rows), 5):
        for _ in range(2):
            store.accept("nation", rows[i : i + 5], key=f"k{i}")
    assert store.flush("nation") == -(-len(rows) // 5)
    return store.snapshot("nation").select("id", F.try_variant_get("metadata", "$.region", "int").alias("region"))


@query("store_history", "select count(*) as n from embeddings where vec_id % 2 = 0")
def store_history(spark, sf_dir):
    """A generation before a delete."""
    store = fresh_store(spark)
    store.create("embeddings", 64)
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("row_seq"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_variant_object(F.struct("label")).alias("metadata"))
    first = store.append("embeddings", Store.upsert_frame(rows))["generation"]
    store.delete("embeddings", everything=True)
    assert store.snapshot("embeddings").isEmpty()
    return store.snapshot("embeddings", generation=first).agg(F.count(F.lit(1)).alias("n"))


@query(
    "queue_summary",
    """select count(*) as depth, count(*) filter (where event_type not in ('view', 'click')) as pending, count(*) filter (where event_type in ('view', 'click')) as leased,
    1800000000000 - epoch_us(min(ts)) // 1000 as oldest_age_ms, max((case when event_type in ('view', 'click') then user_id % 5 + 1 end))::bigint as max_attempt from events""",
)
def queue_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    held = F.col("event_type").isin("view", "click")
    jobs = e.select(F.col("event_id").cast("string").alias("id"), F.floor(_micros() / 1000).alias("enqueued_at_ms"), F.when(held, F.lit("w")).alias("worker_id"), F.when(held, F.col("user_id") % 5 + 1).alias("attempt"))
    return summary(jobs, 1_800_000_000_000)


@query("benchmark_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def benchmark_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("storage_categories", "select category, count(*) as n from (select case when o_orderkey % 4 = 0 then 'manifest' when o_orderkey % 4 = 1 then 'segment' when o_orderkey % 4 = 2 then 'ann_bucket' else 'other' end as category from orders) group by category")
def storage_categories(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    key = F.when(kind == 0, F.concat(F.lit("collections/c/manifests/"), n, F.lit(".json"))).when(kind == 1, F.concat(F.lit("collections/c/segments/"), n)).when(kind == 2, F.concat(F.lit("collections/c/ann/default/1/buckets/"), n, F.lit(".bin"))).otherwise(F.concat(F.lit("collections/c/wal/"), n))
    return table(spark, sf_dir, "orders").groupBy(t.key_category(key).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("apply_lag", "select event_id, (user_id * 1.5)::double as lag from events")
def apply_lag(spark, sf_dir):
    """Between the times of events and later ones, both as RFC 3339 texts in different zones."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (_micros() % 1_000_000_000_000).alias("us"))
    text = lambda us, zone: F.concat(F.date_format(F.timestamp_micros(us + F.lit(zone * 3_600_000_000)).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(f"+{zone:02d}:00"))
    later = F.col("us") + (F.col("user_id") * 1_500_000)
    return e.select("event_id", F.round(t.lag_seconds(text(F.col("us"), 0), text(later, 2)), 6).alias("lag"))


@query("stream_upsert", f"select user_id::varchar as id, round(value, 6) as value from ({_LAST.format('')})")
def stream_upsert(spark, sf_dir):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")
    store.create("events", 1, "dot")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).format("parquet").load(f"{sf_dir}/events.parquet*")
    row = source.select(
        _micros().alias("row_seq"),  # unique in events
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value").cast("float")).alias("values"),
        F.to_variant_object(F.struct("value")).alias("metadata"),
    )
    q = stream_into(store, "events", row, f"{root}/checkpoint")
    q.awaitTermination()
    got = store.snapshot("events")
    return got.select("id", F.round(F.try_variant_get("metadata", "$.value", "double"), 6).alias("value"))
