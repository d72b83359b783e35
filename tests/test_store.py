import tracemalloc

import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.errors import Conflict, InvalidArgument, NotFound, StoreUnavailable
from quarrystone.functions import text, vector
from quarrystone.operators import ann, search
from quarrystone.operators.lexical import LexicalIndex
from quarrystone.operators.placement import Assignment, Placement, put, rebalance
from quarrystone.plans.filters import Typed
from quarrystone.queries import store as store_queries
from quarrystone.sources.objectstore import location
from quarrystone.sources.store import Store, columns_of, rows_of
from quarrystone.streaming import queue


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def ids(df):
    return [r.id for r in df.collect()]


def test_collections(store):
    store.create("c", 2, "dot", {"title": {"full_text_search": True}})
    with pytest.raises(Conflict):
        store.create("c", 2)
    for bad in (("x y", 2), ("d", 0)):
        with pytest.raises(InvalidArgument):
            store.create(*bad)
    with pytest.raises(NotFound):
        store.get("none")
    store.create("b", 3)
    assert [c["name"] for c in store.collections()] == ["b", "c"]
    assert store.page(page_size=1) == {"namespaces": ["b"], "next_cursor": "b"}
    assert store.page(cursor="b") == {"namespaces": ["c"]}
    with pytest.raises(InvalidArgument):
        store.page(page_size=0)
    store.drop("b")
    assert [c["name"] for c in store.collections()] == ["c"]


def test_writes_and_queries(store):
    store.create("c", 2, "dot")
    assert store.stats("c")["vector_count"] == 0
    up = lambda i, v, **m: {"id": i, "values": v, "metadata": m}
    store.upsert("c", [up("a", [1, 0], topic="rust", n=1), up("b", [0.2, 0.1], topic="db"), up("c", [0, 1])])
    first = store.manifest("c")["generation"]
    store.upsert("c", [up("b", [3, 0], topic="db2"), up("b", [2, 0], topic="db")])
    assert ids(store.query("c", [1, 0], 2)) == ["b", "a"]
    assert ids(store.query("c", [1, 0], 10, ["topic", "Eq", "rust"])) == ["a"]
    assert ids(store.query("c", [1, 0], 10, ["Not", ["topic", "Eq", "rust"]])) == ["b", "c"]
    assert ids(store.query("c", [1, 0], 1, generation=first)) == ["a"]
    assert store.delete("c", where=["topic", "Eq", "rust"], ids=[" c ", "none"]) == 2
    assert store.stats("c") == {"dimension": 2, "vector_count": 1, "segments": 3, "generation": 3, "approx_bytes": 8}
    assert store.delete("c", everything=True) == 1
    assert ids(store.query("c", [1, 0])) == []
    for bad in ([up(" ", [1, 2])], [up("x", [1])], [up("x", [1, float("nan")])], [up(" x", [1, 2])]):
        with pytest.raises(InvalidArgument):
            store.upsert("c", bad)
    with pytest.raises(InvalidArgument):
        store.query("c", [1, 0], 0)


def test_idempotency(store):
    store.create("c", 1)
    row = [{"id": "a", "values": [1.0]}]
    store.upsert("c", row, key="k")
    assert store.upsert("c", row, key="k")["generation"] == 1
    with pytest.raises(Conflict):
        store.upsert("c", [{"id": "b", "values": [1.0]}], key="k")


def test_namespace_api(store):
    assert store.write("n")["rows_upserted"] == 0
    store.write("n", upsert_rows=[{"id": 1, "vector": [1.0, 0.0], "topic": "x"}, {"id": "2", "vector": [0.0, 1.0], "topic": "y"}])
    done = store.write("n", upsert_columns={"id": ["3"], "vector": [[1.0, 1.0]], "topic": ["z"]}, deletes=["1", "9"])
    assert done == {"rows_upserted": 1, "rows_deleted": 1, "deleted_ids": ["1", "9"]}
    got = search.project(store.query("n", [1.0, 1.0]), ["vector"], True)
    assert got.columns == ["id", "$dist", "vector"] and ids(got) == ["3", "2"]
    for bad in ({"upsert_rows": [{"id": "1", "vector": [1.0, 2.0]}] * 2}, {"patch_rows": []}, {"upsert_rows": [{"id": True, "vector": []}]}):
        with pytest.raises(InvalidArgument):
            store.write("n", **bad)
    kinds = {r.category for r in store.inventory().collect()}
    assert {"manifest", "segment"} <= kinds
    with pytest.raises(InvalidArgument):
        columns_of({"id": ["1"], "vector": []})
    assert rows_of([{"id": 1.5, "values": [1], "a": 2}]) == [{"id": "1.5", "values": [1], "metadata": {"a": 2}}]
    assert search.namespace_limit({"total": 5, "per": 1}) == 5
    with pytest.raises(InvalidArgument):
        search.namespace_limit(10_001)


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0, -1.0],)], "v array<float>")
    r = df.select(
        vector.dot(F.col("v"), [1.0, 2.0]).alias("short"),
        vector.cosine(F.col("v"), [0.0, 0.0, 0.0]).alias("zero"),
        vector.euclidean(F.col("v"), [0.0, 0.0, -1.0]).alias("far"),
        vector.dot(F.col("v"), [1.0] * 200).alias("long"),
        F.get(vector.signature(F.col("v"), 3), F.lit(0)).alias("bits"),
        vector.hamming(F.array(F.lit(7).cast("long")), F.array(F.lit(2).cast("long"))).alias("h"),
        text.bm25(text.idf(F.lit(1000), F.lit(10)), F.lit(3), F.lit(120), F.lit(100.0)).alias("bm25"),
    ).first()
    assert (r.short, r.zero, r.far, r.long, r.bits, r.h) == (11.0, 0.0, -5.0, 6.0, 3, 2)
    assert abs(r.bm25 - 6.8672843) < 1e-5
    ns, shard = text.parse_shard_namespace(F.lit("a__tvs0007"))
    assert spark.range(1).select(ns, shard).first() == ("a", 7)


def test_saved_index_equals_documents(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Rust database rust", ["a b", "c"]), ("2", "database", None), ("3", None, ["rust"]), ("4", "rustacean", [])], "id string, title string, tags array<string>")
    fresh = LexicalIndex.build(docs, ["title", "tags"])
    fresh.save(str(tmp_path / "i"), 4)
    saved = LexicalIndex.load(docs, str(tmp_path / "i"), ["title", "tags"])
    for tree in (["text", "BM25", "rust database"], ["title", "prefix", "rust"], ["max", ["title", "bm25", "rust"], ["tags", "bm25", "c"]], ["rank_by_filter", ["title", "eq", "database"], ["title", "bm25", "database"], 3]):
        a, b = (i.search(tree, 5, backend=Typed(docs.schema)).collect() for i in (fresh, saved))
        assert [(r.id, round(r.score, 9)) for r in a] == [(r.id, round(r.score, 9)) for r in b] and a
    assert ids(fresh.search(["text", "BM25", "rust database"])) == ["1", "3", "2"] or ids(fresh.search(["text", "BM25", "rust database"]))[0] == "1"
    assert ids(fresh.search(["title", "BM25", "nothing"])) == []


def test_queue():
    jobs = tuple(queue.Job(str(i), "p", i) for i in range(3))
    jobs, got = queue.claim(jobs, "w", 10, most=2)
    assert [j.id for j in got] == ["0", "1"]
    assert [j.id for j in queue.claim(jobs, "w", 11)[1]] == ["0", "1", "2"]
    assert queue.claim(jobs, "v", 11)[1] == []
    assert queue.claim(jobs, "v", 11, one=True)[1][0].id == "2"
    late, got = queue.claim(jobs, "v", 10 + queue.LEASE_MS + 1)
    assert [j.lease.attempt for j in got] == [2, 2, 1]
    assert queue.ack(jobs, "v", ["0"])[1] == 0 and queue.ack(jobs, "w", ["0", "2"])[1] == 1
    beat, ok = queue.heartbeat(jobs, "w", "0", 50)
    assert ok and beat[0].lease.heartbeat_at == 50 and not queue.heartbeat(jobs, "v", "0", 50)[1]
    assert queue.requeue_expired(jobs, 10 + queue.LEASE_MS + 1)[1] == 2


def test_placement_and_locations():
    p = Placement("c", 1, 2, (Assignment(0, "n"), Assignment(1, "n", "offline")))
    assert p.check().serving() == [0] and p.reasons() == ["shard_1_offline"]
    assert [a.node_id for a in rebalance(p, ["b", "a", " a "]).assignments] == ["a", "b"]
    with pytest.raises(Conflict):
        put(p, p, 7)
    with pytest.raises(InvalidArgument):
        put(None, Placement("c", 1, 2, (Assignment(0, "n"),)))
    assert location("AWS", "b", "/x/") == "s3a://b/x" and location("gcs", "b") == "gs://b"
    with pytest.raises(InvalidArgument):
        location("disk", "b")


def test_asking(store):
    store.create("c", 2, "dot", {"title": {"full_text_search": True}, "tags": {"full_text_search": {"k1": 1.0}}, "n": {"type": "int"}})
    rows = [("a", [1.0, 0.0], {"title": "Rust guide", "n": 1}), ("b", [0.0, 1.0], {"title": "database", "tags": ["rust", "db"], "n": 2}), ("c", [2.0, 2.0], {"title": "cooking"})]
    store.upsert("c", [{"id": i, "values": v, "metadata": m} for i, v, m in rows], key="k")
    assert sorted(ids(store.ask("c", ["text", "BM25", "rust"]))) == ["a", "b"]
    assert ids(store.ask("c", ["title", "BM25", "rust"], filters=["n", "Eq", 1])) == ["a"]
    got = store.ask("c", ["vector", "exact", [1, 1]], {"total": 2}, include_attributes=["title", "vector"], exclude_attributes=("vector",))
    assert got.columns == ["id", "$dist", "title"] and [(r.id, r["$dist"]) for r in got.collect()] == [("c", -4.0), ("a", -1.0)]
    assert store.ask("c", ["vector", "ann", [1, 1]], include_attributes=False).columns == ["id", "$dist"]
    assert store.ask("c", ["vector", "ann", [1, 1]], exclude_attributes=("vector", "n")).columns == ["id", "$dist", "attributes"]
    both = store.ask_all("c", [{"rank_by": ["vector", "auto", [0, 1]], "limit": 1, "include_attributes": False}, {"rank_by": ["tags", "prefix", "db"], "include_attributes": False}])
    assert [(r.query_index, r.id) for r in both.collect()] == [(0, "c"), (1, "b")]
    assert ids(store.fetch("c", ["c", " a", "x", "c"])) == ["c", "a"]
    op = next(iter(store.manifest("c")["applied"]))
    assert store.status("c", op) == {"operation": op, "status": "applied", "generation": 1}
    with pytest.raises(NotFound):
        store.status("c", "none")
    assert store.explain("c", "exact")["segments"] == 1


def row(i, v, **m):
    return {"id": i, "values": v, "metadata": m}


def test_idempotency_is_checked_within_the_commit(store):
    """A writer that has looked before another one committed the same key with other rows."""
    store.create("c", 1)
    operation, check = store._once([row("a", [1.0])], "k")
    check(store.manifest("c"))
    store.upsert("c", [row("b", [2.0])], key="k")
    with pytest.raises(Conflict):
        store.commit("c", [], {operation: "x"}, check)
    assert store.manifest("c")["generation"] == 1


def test_manifest_pointer(store):
    store.create("c", 1)
    for i in range(3):
        store.upsert("c", [row(str(i), [1.0])])
    latest = "collections/c/manifests/latest"
    for text in ("1", "nonsense", "9"):  # stale, damaged, ahead
        store.objects.put(latest, text)
        assert store.manifest("c")["generation"] == 3
    store.objects.delete(latest)
    assert store.manifest("c")["generation"] == 3 and store.manifest("c", 2)["generation"] == 2


def test_accept_flush_and_status(store):
    store.create("c", 1, "dot")
    first = store.accept("c", [row("a", [1.0])], key="k")
    assert first["status"] == "accepted" and store.status("c", first["operation"])["status"] == "accepted"
    store.accept("c", [row("a", [1.0])], key="k")
    store.accept("c", [row("a", [2.0]), row("b", [3.0])])
    store.accept("c", [row("z", [9.0])], "other")
    with pytest.raises(InvalidArgument):
        store.accept("c", [row("a", [1.0, 2.0])])
    report = store.queue_report()
    assert report["depth"] == 4 and report["leased"] == 0 and len(report["jobs"]) == 4
    assert ids(store.snapshot("c")) == []
    assert store.flush("c") == 3 and store.flush("c") == 0
    assert store.manifest("c")["generation"] == 2  # one segment for each namespace
    assert {r.id: r["values"] for r in store.snapshot("c").collect()} == {"a": [2.0], "b": [3.0]}
    assert ids(store.snapshot("c", "other")) == ["z"]
    assert store.status("c", first["operation"])["status"] == "applied" and store.queue_report()["depth"] == 0
    with pytest.raises(Conflict):
        store.accept("c", [row("q", [1.0])], key="k")


def test_a_dead_workers_jobs_are_taken_over(store, monkeypatch):
    store.create("c", 1)
    store.accept("c", [row("a", [1.0])])
    store._jobs(lambda jobs: queue.claim(jobs, "dead", 0))
    assert store.flush("c") == 1  # the lease of time 0 is stale


def test_selective_scan_and_compaction(store, spark):
    store.create("c", 1, "dot")
    for i in range(4):
        store.upsert("c", [row("a", [float(i)]), row(f"x{i}", [float(i)])])
    store.upsert("c", [row("n", [1.0])], "other")
    with pytest.raises(StoreUnavailable):
        store.snapshot("c", ids=["a"], most=3)
    plan = store.snapshot("c", ids=["a", "x1"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "IN" in plan.upper()
    assert {r.id: r["values"] for r in store.snapshot("c", ids=["a", "x1", "no"]).collect()} == {"a": [3.0], "x1": [1.0]}
    before = sorted(r.id for r in store.snapshot("c").collect())
    done = store.compact("c")
    assert [s["namespace"] for s in done["segments"]] == ["default", "other"] and done["segments"][0]["rows"] == 5
    assert sorted(r.id for r in store.snapshot("c").collect()) == before and ids(store.snapshot("c", "other")) == ["n"]
    with pytest.raises(Conflict):
        store.commit("c", [], {}, instead_of=("gone",))
    store.upsert("c", [row("a", [7.0])])
    assert store.fetch("c", ["a"]).first()["values"] == [7.0]


def test_sharded_write(store, spark):
    store.create("c", 1)
    rows = store._upserts("c", [row(str(i), [float(i)]) for i in range(40)])
    done = store.append_sharded("c", rows, 3)
    assert sum(s["rows"] for s in done["segments"]) == 40 and len(done["segments"]) == 3
    names = [s["namespace"] for s in done["segments"]]
    assert store.snapshot("c", names).count() == 40
    assert store.stats("c", names[0])["vector_count"] == done["segments"][0]["rows"]


def test_stored_vectors(store, spark):
    """Strategies, fallbacks and what explain says; only the probed buckets' folders are read."""
    store.create("c", 2, "euclidean")
    store.upsert("c", [row(f"{i:03d}", [float(i % 20), float(i // 20)], n=i) for i in range(400)])
    want = ids(store.query("c", [3.2, 4.1], 5))
    got, note = store.find("c", [3.2, 4.1], 5, strategy="ann")
    assert note["fallback_reasons"] == ["index_missing"] and ids(got) == want and store.explain("c")["path"] == "ann_fallback"
    assert store.ensure_vectors("c") is False and store.ensure_vectors("c", buckets=64, least=1) and store.ensure_vectors("c")
    got, note = store.find("c", [3.2, 4.1], 5, strategy="auto", small=0)
    assert note["path"] == "ann" and note["probes"] < 64 and ids(got) == want
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString().replace("InSet", "") or "bucket" in got._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
    got, note = store.find("c", [3.2, 4.1], 5, ["n", "Lt", 100], strategy="ann", small=0)
    assert ids(got) == ids(store.query("c", [3.2, 4.1], 5, ["n", "Lt", 100]))
    # buckets without a match aren't read; a complement rules none out
    far, how = store.find("c", [3.2, 4.1], 5, ["n", "Gte", 395], strategy="ann", small=0)
    assert sorted(ids(far)) == ["395", "396", "397", "398", "399"] and how["probes"] <= 5
    got, how = store.find("c", [3.2, 4.1], 5, ["Not", ["n", "Lt", 395]], strategy="ann", small=0)
    assert sorted(ids(got)) == sorted(ids(far))
    index = ann.AnnIndex.load(spark, store.objects.uri(store._index("c", "ann", "default", 1)))
    rows = store.snapshot("c")
    assert ann.query(index, rows, [3.2, 4.1], 5, "euclidean", small=0, reads=2)[1]["fallback_reasons"] == ["read_budget_exceeded"]
    assert ann.merged([note, {"path": "ann_fallback", "fallback_reasons": ["index_missing"]}])["path"] == "ann_fallback"
    assert store.find("c", [3.2, 4.1], 5, strategy="ann")[1]["small_corpus"] and store.explain("c")["small_corpus"]
    assert store.query("c", [3.2, 4.1], 5, include_metadata=False, include_values=False).columns == ["id", "score"]
    assert ids(store.ask("c", ["vector", "ann", [3.2, 4.1]], 5)) == want
    store.upsert("c", [row("new", [3.2, 4.1])])  # the index is of an older generation
    assert store.find("c", [3.2, 4.1], 1, strategy="ann")[1]["fallback_reasons"] == ["index_missing"]
    assert ids(store.query("c", [3.2, 4.1], 1, strategy="ann")) == ["new"]


def test_vectors_that_are_none(spark):
    """Null vectors, and such of another dimension, have no bucket."""
    rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(50)] + [("n", None), ("s", [1.0]), ("x", [1.0, None]), ("y", [float("nan"), 1.0])], "id string, values array<float>")
    got = {r.id: r.bucket for r in ann.assign(rows, ann.np.array([[0.0, 1.0], [40.0, 1.0]]), "euclidean").collect()}
    assert [got[x] for x in ("n", "s", "x", "y", "0", "49")] == [None, None, None, None, 0, 1]
    index = ann.build(rows, 2, "euclidean", buckets=4, least=1)
    assert index.vectors == 50 and len(index.centroids) == 4
    assert ann.build(rows.filter("id = 'n'"), 2, least=1) is None
    queries = spark.createDataFrame([(1, [7.0, 1.0])], "query_id long, q array<double>")
    assert [r.id for r in ann.batch(index, queries, 3).orderBy("rank").collect()][0] == "7"


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_best_of_many_queries_in_bounded_memory(metric):
    """Slices and cuts give what sorting all scores gives, ties by id, and memory doesn't grow with rows times queries."""
    rng = ann.np.random.default_rng(1)
    v, own = rng.normal(size=(6_000, 8)), rng.normal(size=(1_500, 8))
    v[100:1100] = v[100]  # ties
    own[:300] = v[100]
    best = search._Best(own, 5, metric, 4096)
    tracemalloc.start()
    for i in range(0, 6_000, 2_000):
        best.see(v[i : i + 2_000], pa.array([f"{j:04d}" for j in range(i, i + 2_000)]))
    got = best.table()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36e6 and len(got) == 7_500  # all scores are 72 MB
    for q in (0, 7, 299, 300, 1_499):
        s = search.paired(metric, v, ann.np.broadcast_to(own[q], v.shape))
        want = sorted((-x, f"{j:04d}") for j, x in enumerate(s))[:5]
        assert [(-r["score"], r["id"]) for r in got.filter(pa.compute.equal(got["q"], q)).to_pylist()] == want


def test_nearest_of_many_centroids_in_bounded_memory():
    rng = ann.np.random.default_rng(1)
    v, c = rng.normal(size=(2_000, 8)), rng.normal(size=(20_000, 8))
    tracemalloc.start()
    got = ann.nearest("euclidean", v, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6 and len(got) == 2_000  # all scores are 320 MB
    assert (got[:50] == ((v[:50, None] - c[None]) ** 2).sum(2).argmin(1)).all()


@pytest.mark.parametrize("parts", [1, 4])
def test_events_are_dealt_out_without_gathering_them(spark, parts):
    """The parts of ntile and the order of keys, and no task that reads all rows."""
    rows = spark.range(1003).select((F.col("id") * 7919 % 250).alias("us"), F.col("id").alias("event_id"))
    want = rows.select("*", F.ntile(parts).over(Window.orderBy("us", "event_id")).alias("part")).collect()
    got = store_queries._in_parts(rows, ["us", "event_id"], parts)
    assert len(got) == parts
    for i, part in enumerate(got, 1):
        assert "SinglePartition" not in part._jdf.queryExecution().toString()
        found = part.orderBy("row_seq").collect()
        assert [(r.us, r.event_id) for r in found] == sorted((r.us, r.event_id) for r in want if r.part == i) and len({r.row_seq for r in found}) == len(found)


def test_delete_takes_a_frame_of_ids(store, spark):
    store.create("c", 1)
    store.upsert("c", [row(str(i), [1.0], n=i) for i in range(6)])
    gone = spark.createDataFrame([(" 1 ",), ("1",), ("none",)], "id string")
    assert store.delete("c", ids=gone) == 1 and sorted(ids(store.snapshot("c"))) == ["0", "2", "3", "4", "5"]
    assert store.delete("c", ids=gone.limit(0)) == 0 and store.delete("c", ids=spark.createDataFrame([("2",)], "id string"), where=["n", "Gte", 4]) == 3
    assert sorted(ids(store.snapshot("c"))) == ["0", "3"]


def test_tokens_are_lowered_at_once_where_that_is_the_same(spark):
    """Every character within a word, and the two whose lower letters are two, or depend on their neighbours."""
    cut = lambda x: F.transform(F.array_remove(F.split(x, r"[^\p{IsAlphabetic}\p{N}]+"), ""), F.lower)
    texts = ["".join(f"A{chr(c)}B {chr(c)} " for c in range(i, i + 4096) if not 0xD800 <= c < 0xE000 and c not in (0x130, 0x3A3)) for i in range(0, 0x30000, 4096)]
    df = spark.createDataFrame([(x,) for x in [*texts, "\u0130stanbul X", "\u039f\u03a3 \u0391\u03a3'\u0391", "", None]], "x string")
    for r in df.select(cut(F.col("x")).alias("want"), text.tokens(F.col("x")).alias("got")).collect():
        assert r.got == r.want
    plan = df.select(text.tokens(F.col("x")))._jdf.queryExecution().toString()
    assert "split(lower(" in plan


def test_lengths_need_no_sort(spark):
    """Lengths and statistics come from the tokens, without sorting or counting within rows; counts are cut at the largest."""
    docs = spark.createDataFrame([("1", "b a b"), ("2", "a " * 70_000 + "c"), ("3", ""), ("4", None), ("5", "A c")], "id string, body string")
    i = LexicalIndex.build(docs, ["body"])
    assert sorted(tuple(r) for r in i.term_stats().collect()) == [("body", "a", 3, 65_537), ("body", "b", 1, 2), ("body", "c", 2, 2)]
    assert sorted((r.id, r.len) for r in i.doc_lookup().collect()) == [("1", 3), ("2", 65_535), ("5", 2)]
    assert "array_sort" not in i.doc_lookup()._jdf.queryExecution().toString() + i.stats._jdf.queryExecution().toString()


def test_stored_texts(store, spark):
    """The stored index answers as a fresh one, is read by its terms' folders, and follows writes and deletes."""
    store.create("c", 1, "dot", {"title": {"full_text_search": True}})
    words = ["rust", "data", "base", "guide"]
    store.upsert("c", [row(str(i), [0.0], title=" ".join(words[j % 4] for j in range(i, i + i % 5 + 1))) for i in range(30)])
    tree = ["title", "BM25", "rust guide"]
    show = lambda: [(r.id, round(r.score, 9)) for r in store.search("c", tree, 8).collect()]
    fresh = show()
    assert store.ensure_texts("c") and show() == fresh
    plan = store.search("c", tree, 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    store.upsert("c", [row("5", [0.0], title="rust rust rust"), row("new", [0.0], title="guide")])
    store.delete("c", ids=["7"])
    after = show()
    assert after != fresh and store.ensure_texts("c") and show() == after
    store.delete("c", everything=True)
    assert store.ensure_texts("c") and show() == []


def test_worker_round(store):
    store.create("c", 1, "dot", {"title": {"full_text_search": True}})
    store.create("d", 1)
    store.accept("c", [row("a", [1.0], title="rust")])
    assert store.work() == {"c": ["flushed", "texts"], "d": []}
    assert store.work() == {"c": ["texts"], "d": []}
    assert ids(store.search("c", ["title", "BM25", "rust"])) == ["a"]


def test_stored_placement(store):
    assert store.placement("c") is None
    one = store.place("c", Placement("c", 1, 2, (Assignment(0, "n"), Assignment(1, "m", "offline"))), 0)
    assert one.version == 1 and store.placement("c") == one
    with pytest.raises(Conflict):
        store.place("c", one, 0)
    assert store.place("c", rebalance(one, ["x"], True), 1).version == 2
    assert [a.node_id for a in store.placement("c").assignments] == ["x", "x"]
