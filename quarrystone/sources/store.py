"""Collections on an object store: a catalog, an append-only log, versioned manifests."""

from __future__ import annotations

import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidArgument, NotFound, StoreUnavailable
from ..functions import text as t
from ..functions.vector import METRICS
from ..operators import ann, placement, search
from ..operators.lexical import LexicalIndex
from ..plans import budget, rank
from ..plans.filters import Variant, compile_filter
from ..streaming import queue
from .objectstore import ObjectStore
from .segments import SCHEMA, visible

_started, _counter = time.time_ns(), itertools.count()


def operation_id() -> str:
    """An id that sorts after all earlier ones of this process: when it started, and a counter."""
    return f"{_started:032x}{next(_counter):016x}"


NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")
ATTEMPTS = 8


def name_of(x: str) -> str:
    x = x.strip()
    if not NAME.fullmatch(x):
        raise InvalidArgument(f"{x!r} isn't a name: letters, digits, _ . - and at most 128 bytes")
    return x


def rows_of(items: Iterable[dict]) -> list[dict]:
    """upsert_rows: id (text or number), vector or values, all other keys are metadata."""
    out = []
    for item in items:
        item = dict(item)
        id_, values = item.pop("id", None), item.pop("vector", item.pop("values", None))
        if isinstance(id_, bool) or not isinstance(id_, int | float | str):
            raise InvalidArgument("a row needs an id: a text or a number")
        if not isinstance(values, list):
            raise InvalidArgument("a row needs a vector")
        out.append({"id": str(id_), "values": values, "metadata": item or None})
    return out


def columns_of(columns: dict[str, list]) -> list[dict]:
    """upsert_columns: lists of one length, id and vector among them."""
    if "id" not in columns or not ("vector" in columns or "values" in columns):
        raise InvalidArgument("columns need id and vector")
    if len({len(v) for v in columns.values()}) != 1:
        raise InvalidArgument("columns differ in length")
    return rows_of(dict(zip(columns, vals, strict=True)) for vals in zip(*columns.values(), strict=True))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.objects = spark, ObjectStore(spark, root)

    # catalog

    def create(self, name: str, dimension: int, metric: str = "cosine", schema: dict | None = None) -> dict:
        name = name_of(name)
        if not isinstance(dimension, int) or dimension < 1:
            raise InvalidArgument("dimension must be greater than 0")
        if metric not in METRICS:
            raise InvalidArgument(f"metric is one of {', '.join(METRICS)}")
        if schema is not None and not isinstance(schema, dict):
            raise InvalidArgument("metadata_schema must be an object")
        entry = {"name": name, "dimension": dimension, "metric": metric, "created_at": time.time(), "metadata_schema": schema}
        self.objects.put(f"collections/_registry/{name}.json", json.dumps(entry), absent=True)
        return entry

    def get(self, name: str) -> dict:
        return json.loads(self.objects.get(f"collections/_registry/{name_of(name)}.json"))

    def set_schema(self, name: str, schema: dict) -> None:
        if not isinstance(schema, dict):
            raise InvalidArgument("metadata_schema must be an object")
        self.objects.put(f"collections/_registry/{name}.json", json.dumps(self.get(name) | {"metadata_schema": schema}))

    def collections(self) -> list[dict]:
        return [json.loads(self.objects.get(k)) for k in self.objects.list("collections/_registry") if k.endswith(".json")]

    def drop(self, name: str) -> None:
        self.get(name)
        self.objects.delete(f"collections/{name}")
        self.objects.delete(f"collections/_registry/{name}.json")

    def page(self, prefix: str = "", cursor: str | None = None, page_size: int = 100) -> dict:
        """Names after the cursor; next_cursor only if there are more."""
        if page_size < 1 or page_size > 1000:
            raise InvalidArgument("page_size is from 1 to 1000")
        names = [c["name"] for c in self.collections() if c["name"].startswith(prefix) and (cursor is None or c["name"] > cursor)]
        out: dict = {"namespaces": names[:page_size]}
        if len(names) > page_size:
            out["next_cursor"] = out["namespaces"][-1]
        return out

    # manifests

    def manifest(self, name: str, generation: int | None = None) -> dict:
        """A generation's manifest; by default the latest. Without writes an empty one.

        The pointer tells a generation that exists; newer ones follow it without
        a gap. A pointer that is missing or damaged is made up for by listing.
        """
        if generation is None:
            base = f"collections/{name}/manifests"
            try:
                generation = int(self.objects.get(f"{base}/latest"))
                if not self.objects.exists(f"{base}/{generation}.json"):
                    raise ValueError(generation)
            except (NotFound, ValueError):
                generation = max((int(m[1]) for k in self.objects.list(base) if (m := re.search(r"/(\d+)\.json$", k))), default=0)
            while self.objects.exists(f"{base}/{generation + 1}.json"):
                generation += 1
            if not generation:
                return {"generation": 0, "segments": [], "applied": {}}
        return json.loads(self.objects.get(f"collections/{name}/manifests/{generation}.json"))

    def commit(self, name: str, segments: list[dict], applied: dict[str, str], check: Callable[[dict], None] | None = None, instead_of: tuple[str, ...] = ()) -> dict:
        """Publish segments as one new generation; applied operations are skipped ones from then on.

        check: looks at the manifest that is about to be followed, and may refuse.
        instead_of: segments that the first new one replaces, in the place of the last of them.
        """
        base = f"collections/{name}/manifests"
        for _ in range(ATTEMPTS):
            now = self.manifest(name)
            if applied and all(k in now["applied"] for k in applied):
                return now
            if check:
                check(now)
            held = now["segments"]
            if instead_of:
                at = [i for i, s in enumerate(held) if s["id"] in instead_of]
                if len(at) != len(instead_of):
                    raise Conflict(f"{name}: segments were replaced by another writer")
                held = [s for s in [*held[: at[-1] + 1], *segments, *held[at[-1] + 1 :]] if s["id"] not in instead_of]
            else:
                held = held + segments
            new = {"generation": now["generation"] + 1, "previous_generation": now["generation"] or None, "segments": held, "applied": now["applied"] | applied}
            try:
                self.objects.put(f"{base}/{new['generation']}.json", json.dumps(new), absent=True)
            except Conflict:
                continue
            self.objects.put(f"{base}/latest", str(new["generation"]))
            return new
        raise Conflict(f"{name}: another writer won {ATTEMPTS} times")

    def _written(self, rows: DataFrame, uri: str, by: str | None = None) -> int:
        """Writes a segment and counts it again as stored; if rows are missing it is not published."""
        seen = Observation()
        out = rows.sortWithinPartitions("id").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
        (out.partitionBy(by) if by else out).parquet(uri)
        n = seen.get["n"]
        if by is None and self.spark.read.parquet(uri).count() != n:  # row counts come from the files' footers
            self.objects.delete(uri[len(self.objects.root) + 1 :])
            raise StoreUnavailable(f"{uri}: the segment doesn't hold the {n} rows that were written")
        return n

    def append(self, name: str, rows: DataFrame, namespace: str = "default", operation: str | None = None, applied: tuple[str, ...] = (), check: Callable[[dict], None] | None = None) -> dict:
        """Write rows of SCHEMA (without namespace) as a segment and publish it.

        operation: an id under which the write happens once, however often it is
        asked for; applied: others that it covers.
        """
        done = self.manifest(name)
        if operation and operation in done["applied"]:
            return done
        if check:
            check(done)
        segment = uuid.uuid4().hex
        n = self._written(rows.withColumn("namespace", F.lit(name_of(namespace))), self.objects.uri(f"collections/{name}/segments/segment={segment}"))
        return self.commit(name, [{"id": segment, "namespace": namespace, "rows": n}], {k: segment for k in (*([operation] if operation else []), *applied)}, check)

    def append_sharded(self, name: str, rows: DataFrame, shards: int, namespace: str = "default") -> dict:
        """The same for log rows that are dealt out to shard namespaces: one job, a segment for each shard, published together."""
        segment = uuid.uuid4().hex
        base = self.objects.uri(f"collections/{name}/segments")
        shard = t.shard_of(name, name_of(namespace), F.col("id"), shards)
        own = rows.withColumn("_shard", shard).withColumn("namespace", t.shard_namespace(F.lit(namespace), F.col("_shard")))
        own = own.withColumn("segment", F.concat(F.lit(f"{segment}-"), F.col("_shard").cast("string"))).drop("_shard")
        self._written(own.repartition(shards, "segment"), base, "segment")
        found = self.spark.read.option("basePath", base).parquet(*[f"{base}/segment={segment}-{i}" for i in range(shards) if self.objects.exists(f"collections/{name}/segments/segment={segment}-{i}")])
        held = found.groupBy("segment", "namespace").count().collect()  # a row for each shard
        return self.commit(name, [{"id": r.segment, "namespace": r.namespace, "rows": r["count"]} for r in sorted(held)], {})

    def compact(self, name: str, namespace: str = "default") -> dict:
        """Replace a namespace's segments by one that holds what is visible of them. Writes in between stay newer than it."""
        m = self.manifest(name)
        own = tuple(s["id"] for s in m["segments"] if s["namespace"] == namespace)
        if len(own) < 2:
            return m
        rows = self.snapshot(name, namespace, m["generation"]).withColumn("row_seq", F.lit(0).cast("long"))
        segment = uuid.uuid4().hex
        n = self._written(self.upsert_frame(rows).withColumn("namespace", F.lit(namespace)), self.objects.uri(f"collections/{name}/segments/segment={segment}"))
        return self.commit(name, [{"id": segment, "namespace": namespace, "rows": n}], {}, instead_of=own)

    # rows

    def _upserts(self, name: str, rows: list[dict]) -> DataFrame:
        dimension = self.get(name)["dimension"]
        data = []
        for i, r in enumerate(rows):
            if not r["id"].strip() or r["id"] != r["id"].strip():
                raise InvalidArgument("ids must not be blank or have outer blanks")
            if r.get("metadata") is not None and not isinstance(r["metadata"], dict):
                raise InvalidArgument("metadata must be an object")
            data.append((i, r["id"], search.check_vector(r["values"], dimension), json.dumps(r.get("metadata"))))
        df = self.spark.createDataFrame(data, "row_seq long, id string, values array<float>, m string")
        return self.upsert_frame(df.withColumn("metadata", F.parse_json("m")).drop("m"))

    @staticmethod
    def upsert_frame(df: DataFrame) -> DataFrame:
        """row_seq, id, values, metadata (VARIANT) as log rows; frames of any size."""
        return df.select("row_seq", F.lit("upsert").alias("op"), "id", "values", "metadata", F.lit(None).cast("string").alias("delete_filter"))

    @staticmethod
    def _once(rows: list[dict], key: str | None) -> tuple[str | None, Callable[[dict], None] | None]:
        """The operation of an idempotency key, and a check that no other payload used it."""
        if not key:
            return None, None
        operation = f"key:{key}:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(rows, sort_keys=True)).hex}"

        def check(manifest: dict) -> None:
            if any(k.startswith(f"key:{key}:") and k != operation for k in manifest["applied"]):
                raise Conflict("the key was used for another payload")

        return operation, check

    def upsert(self, name: str, rows: list[dict], namespace: str = "default", key: str | None = None) -> dict:
        """key: an idempotency key; the same key with other rows is a conflict, also if both are written at once."""
        operation, check = self._once(rows, key)
        return self.append(name, self._upserts(name, rows), namespace, operation, check=check)

    def _log(self, name: str, segments: list[str]) -> DataFrame:
        """The log rows of some segments, with seg_seq, their place in the list."""
        base = self.objects.uri(f"collections/{name}/segments")
        order = self.spark.createDataFrame([(s, i) for i, s in enumerate(segments)], "segment string, seg_seq int")
        log = self.spark.read.schema(f"{SCHEMA}, segment string").option("basePath", base).parquet(*[f"{base}/segment={s}" for s in segments])
        return log.join(F.broadcast(order), "segment").drop("segment")  # a row for each segment

    def snapshot(self, name: str, namespace: str | list[str] = "default", generation: int | None = None, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
        """id, values, metadata (and namespace, if several are asked for) as of a generation. Only the namespaces' segments are read.

        ids: only these; they are looked for in the files (whose rows are in the
        order of ids), below the replay, so other rows aren't decoded. most:
        segments to read; more of them are an error.
        """
        m = self.manifest(name, generation)
        several = not isinstance(namespace, str)
        of = set(namespace) if several else {namespace}
        columns = [*(["namespace"] if several else []), "id", "values", "metadata"]
        own = [s["id"] for s in m["segments"] if s["namespace"] in of]
        if not own:
            return self.spark.createDataFrame([], f"{'namespace string, ' if several else ''}id string, values array<float>, metadata variant")
        if most is not None and len(own) > most:
            raise StoreUnavailable(f"{name}: {len(own)} segments to read, {most} are allowed; compact() makes one of them")
        log = self._log(name, own)
        if ids is not None:
            log = log.filter(F.col("id").isin(ids) | F.col("op").isin("delete_all", "delete_filter"))
        return visible(log).select(*columns)

    def delete(self, name: str, namespace: str = "default", ids: list[str] | DataFrame | None = None, where: Any = None, everything: bool = False) -> int:
        """Delete rows by id or filter (either suffices), or all. Returns how many there were. ids: a list, or for many of them a frame with a column id, which is joined and never collected."""
        listed = not isinstance(ids, DataFrame)
        if not (not listed or ids or where is not None or everything):
            raise InvalidArgument("nothing to delete: give ids, a filter or delete_all")
        if not listed:
            ids = ids.select(F.trim("id").alias("id"), F.lit(True).alias("_asked")).distinct()
        wanted = [i.strip() for i in ids or []] if listed else []
        # ids alone need no other rows
        now = self.snapshot(name, namespace, ids=None if everything or where is not None or not listed else wanted)
        hit = F.lit(everything)
        if wanted:
            hit = hit | F.col("id").isin(wanted)
        if not listed:
            now = now.join(ids, "id", "left")
            hit = hit | F.col("_asked").isNotNull()
        if where is not None:
            hit = hit | compile_filter(where, Variant(F.col("metadata")))
        gone = now.filter(hit).select("id")
        n = gone.count()
        if n:
            empty = [F.lit(0).cast("long").alias("row_seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("variant").alias("metadata"), F.lit(None).cast("string").alias("delete_filter")]
            self.append(name, gone.select(*empty), namespace)
        return n

    def stats(self, name: str, namespace: str = "default") -> dict:
        m = self.manifest(name)
        c = self.get(name)
        n = self.snapshot(name, namespace).count()
        return {"dimension": c["dimension"], "vector_count": n, "segments": sum(s["namespace"] == namespace for s in m["segments"]), "generation": m["generation"], "approx_bytes": n * c["dimension"] * 4}

    # indexes: derived tables of one generation of a namespace

    def _index(self, name: str, kind: str, namespace: str, generation: int) -> str:
        return f"collections/{name}/{kind}/{namespace}/{generation}"

    def ensure_vectors(self, name: str, namespace: str = "default", buckets: int | None = None, least: int = budget.MIN_VECTORS) -> bool:
        """Build and store the approximate index of the latest generation, if it isn't there; false below `least` rows."""
        c, m = self.get(name), self.manifest(name)
        key = self._index(name, "ann", namespace, m["generation"])
        if self.objects.exists(f"{key}/ready"):
            return True
        made = ann.build(self.snapshot(name, namespace, m["generation"]), c["dimension"], c["metric"], buckets=buckets, least=least)
        if made is None:
            return False
        made.save(self.objects.uri(key))
        self.objects.put(f"{key}/ready", "")
        return True

    def ensure_texts(self, name: str, namespace: str = "default") -> bool:
        """Store the full-text index of the latest generation: anew, or from an older one's, of which only changed documents are indexed again."""
        fields = self._text_fields(name)
        if not fields:
            return False
        m, schema = self.manifest(name), self.get(name)["metadata_schema"]
        key = self._index(name, "fts", namespace, m["generation"])
        if self.objects.exists(f"{key}/ready"):
            return True
        made = self._from_older(name, namespace, m, fields, schema) or LexicalIndex.build(self.texts(name, fields, namespace), fields, schema)
        made.save(self.objects.uri(key))
        self.objects.put(f"{key}/ready", json.dumps({"fields": fields}))
        return True

    def _from_older(self, name: str, namespace: str, m: dict, fields: list[str], schema: dict) -> LexicalIndex | None:
        done = [int(k.split("/")[-2]) for k in self.objects.list(f"collections/{name}/fts/{namespace}") if k.endswith("/ready")]
        for old in sorted((g for g in done if g < m["generation"]), reverse=True)[:1]:
            before = {s["id"] for s in self.manifest(name, old)["segments"]}
            now = [s["id"] for s in m["segments"] if s["namespace"] == namespace]
            fresh = [s for s in now if s not in before]
            key = self._index(name, "fts", namespace, old)
            if not before <= {s["id"] for s in m["segments"]} or json.loads(self.objects.get(f"{key}/ready")).get("fields") != fields:
                return None  # segments were replaced, or other fields were indexed
            log = self._log(name, fresh) if fresh else None
            if log is not None and not log.filter(F.col("op").isin("delete_all", "delete_filter")).isEmpty():
                return None
            texts = self.texts(name, fields, namespace)
            stored = LexicalIndex.load(texts, self.objects.uri(key), fields, schema)
            return stored.changed(log.select("id").distinct(), texts) if log is not None else stored
        return None

    def work(self) -> dict[str, list[str]]:
        """One round of the worker: flush what waits in all collections, then bring their indexes up to date."""
        out = {}
        for c in self.collections():
            name, did = c["name"], []
            if self.flush(name):
                did.append("flushed")
            for namespace in sorted({s["namespace"] for s in self.manifest(name)["segments"]}):
                did += [kind for kind, ready in (("vectors", self.ensure_vectors), ("texts", self.ensure_texts)) if ready(name, namespace)]
            out[name] = did
        return out

    # write log and queue: writes are accepted first, and applied in groups

    def _jobs(self, change: Callable[[tuple], tuple[tuple, Any]]) -> Any:
        """Change the queue by compare-and-set; change: jobs -> jobs, result."""
        for _ in range(ATTEMPTS):
            text, version = self.objects.versioned("queue/jobs")
            jobs, result = change(queue.loads(text) if text else ())
            try:
                self.objects.put_versioned("queue/jobs", queue.dumps(jobs), version)
                return result
            except Conflict:
                continue
        raise Conflict(f"the queue: another writer won {ATTEMPTS} times")

    def accept(self, name: str, rows: list[dict], namespace: str = "default", key: str | None = None) -> dict:
        """Log a write, to be applied by the next flush. It is checked now, and counts once for each key."""
        operation, check = self._once(rows, key)
        operation = operation or f"write:{operation_id()}"
        self._upserts(name, rows)
        if check:
            check(self.manifest(name))
        at = f"collections/{name}/wal/{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        self.objects.put(at, json.dumps({"operation": operation, "namespace": name_of(namespace), "rows": rows}), absent=True)
        self._jobs(lambda jobs: ((*jobs, queue.Job(at, name, int(time.time() * 1000))), None))
        return {"operation": operation, "status": "accepted"}

    def flush(self, name: str, worker: str = "flush") -> int:
        """Apply the logged writes of a collection: one segment for each namespace. Returns how many were applied.

        The worker leases the jobs; if it dies, another takes them over. Writes
        that a dead worker had published already are skipped by their operation.
        """
        now = int(time.time() * 1000)

        def claim(jobs: tuple) -> tuple[tuple, list]:
            own, others = tuple(j for j in jobs if j.payload == name), tuple(j for j in jobs if j.payload != name)
            own, got = queue.claim(own, worker, now)
            return (*others, *own), got

        got = self._jobs(claim)
        entries = [json.loads(self.objects.get(j.id)) for j in got if self.objects.exists(j.id)]
        applied = self.manifest(name)["applied"]
        fresh = list({e["operation"]: e for e in entries if e["operation"] not in applied}.values())
        for namespace in dict.fromkeys(e["namespace"] for e in fresh):
            own = [e for e in fresh if e["namespace"] == namespace]
            self.append(name, self._upserts(name, [r for e in own for r in e["rows"]]), namespace, applied=tuple(e["operation"] for e in own))
        for j in got:
            self.objects.delete(j.id)
        self._jobs(lambda jobs: queue.ack(jobs, worker, [j.id for j in got]))
        return len(fresh)

    def queue_report(self) -> dict:
        """What waits, and the first 50 jobs."""
        text, _ = self.objects.versioned("queue/jobs")
        return queue.report(queue.loads(text) if text else (), int(time.time() * 1000))

    # placement

    def placement(self, name: str) -> placement.Placement | None:
        text, _ = self.objects.versioned(f"placements/{name}")
        return placement.loads(text) if text else None

    def place(self, name: str, new: placement.Placement, expected: int | None = None) -> placement.Placement:
        """Store a placement if its version is the one expected."""
        text, version = self.objects.versioned(f"placements/{name}")
        done = placement.put(placement.loads(text) if text else None, new, expected)
        self.objects.put_versioned(f"placements/{name}", placement.dumps(done), version)
        return done

    # queries

    def find(self, name: str, values: list[float], k: int = 10, where: Any = None, namespace: str = "default", generation: int | None = None, strategy: str = "exact", small: int = budget.SMALL) -> tuple[DataFrame, dict]:
        """The k closest rows and how they were found. strategy: exact, ann or auto, which takes the stored index where there is one."""
        c = self.get(name)
        search.check_vector(values, c["dimension"])
        rows, backend = self.snapshot(name, namespace, generation), Variant(F.col("metadata"))
        index, note = (None, {}) if strategy == "exact" else self._stored(name, namespace, generation)
        found, how = ann.query(index, rows, values, k, c["metric"], where, backend, strategy if index or strategy == "exact" else "exact", small=small)
        return found, how | note

    def _stored(self, name: str, namespace: str, generation: int | None) -> tuple[ann.AnnIndex | None, dict]:
        key = self._index(name, "ann", namespace, generation or self.manifest(name)["generation"])
        if not self.objects.exists(f"{key}/ready"):
            return None, {"path": "ann_fallback", "fallback_reasons": ["index_missing"]}
        return ann.AnnIndex.load(self.spark, self.objects.uri(key)), {}

    def query(self, name: str, values: list[float], k: int = 10, where: Any = None, namespace: str = "default", generation: int | None = None, strategy: str = "exact", include_metadata: bool = True, include_values: bool = True) -> DataFrame:
        found = self.find(name, values, k, where, namespace, generation, strategy)[0]
        return found.drop(*([] if include_metadata else ["metadata"]), *([] if include_values else ["values"]))

    def fetch(self, name: str, ids: list[str], namespace: str = "default") -> DataFrame:
        """Rows by id in the order of the request."""
        return search.fetch(self.snapshot(name, namespace, ids=[i.strip() for i in ids]), ids)

    def status(self, name: str, operation: str) -> dict:
        """Where an operation stands: accepted, applied (with the manifest's generation), or not known."""
        m = self.manifest(name)
        if operation in m["applied"]:
            return {"operation": operation, "status": "applied", "generation": m["generation"]}
        waiting = [k for k in self.objects.list(f"collections/{name}/wal")]
        if any(json.loads(self.objects.get(k))["operation"] == operation for k in waiting):
            return {"operation": operation, "status": "accepted", "waiting": len(waiting)}
        raise NotFound(operation)

    def explain(self, name: str, strategy: str = "auto", where: Any = None, namespace: str = "default", k: int = 10) -> dict:
        """The steps that a vector query takes, as find() would take them."""
        m, c = self.manifest(name), self.get(name)
        own = sum(s["namespace"] == namespace for s in m["segments"])
        index, note = (None, {"path": "exact"}) if strategy == "exact" else self._stored(name, namespace, None)
        kept = ["filter metadata"] if where is not None else []
        out = {"generation": m["generation"], "segments": own} | note
        if index is None or index.vectors <= budget.SMALL:
            steps = [f"read generation {m['generation']}", f"replay {own} segments", *kept, f"score by {c['metric']}", "keep the best"]
            return {"path": "ann", "small_corpus": True} | out | {"steps": steps} if index else out | {"steps": steps}
        plan = budget.budget(k, index.vectors, len(index.centroids), where is not None)
        steps = [f"read {plan.probes} of {len(index.centroids)} buckets of generation {m['generation']}", *kept, f"keep {plan.candidates} candidates by signature", f"score by {c['metric']}", "keep the best"]
        return out | {"path": "ann", "probes": plan.probes, "candidates": plan.candidates, "steps": steps}

    def texts(self, name: str, fields: list[str], namespace: str = "default") -> DataFrame:
        """id, the fields as arrays of texts (a text, or the texts of an array), and metadata: what a LexicalIndex is built of."""
        v = Variant(F.col("metadata"))
        many = lambda f: F.when(F.startswith(F.schema_of_variant(v._item(f)), F.lit("ARRAY")), v._get(f, "array<variant>"))
        one = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        each = [F.coalesce(F.array_compact(F.transform(many(f), one)), F.array_compact(F.array(v.text(f)))).alias(f) for f in fields]
        return self.snapshot(name, namespace).select("id", *each, "metadata")

    def _text_fields(self, name: str) -> list[str]:
        schema = self.get(name)["metadata_schema"] or {}
        return [f for f, e in schema.items() if isinstance(e, dict) and e.get("full_text_search")]

    def search(self, name: str, tree: Any, k: int = 10, where: Any = None, fields: list[str] | None = None, namespace: str = "default") -> DataFrame:
        """BM25 over the metadata. fields: by default those that the schema indexes; for these the stored index of the latest generation is read, if there is one."""
        indexed, schema = self._text_fields(name), self.get(name)["metadata_schema"] or {}
        key = self._index(name, "fts", namespace, self.manifest(name)["generation"])
        stored = fields is None and self.objects.exists(f"{key}/ready") and json.loads(self.objects.get(f"{key}/ready"))["fields"] == indexed
        fields = fields or indexed
        if not fields:
            raise InvalidArgument("no field is indexed for full-text search")
        if stored:
            # documents are read for filters and boosts only
            needed = where is not None or rank.boosts(rank.parse(tree))
            docs = self.snapshot(name, namespace).select("id", "metadata") if needed else self.spark.createDataFrame([], "id string, metadata variant")
            index = LexicalIndex.load(docs, self.objects.uri(key), fields, schema)
        else:
            index = LexicalIndex.build(self.texts(name, fields, namespace), fields, schema)
        return index.search(tree, k, where, Variant(F.col("metadata")))

    # namespace API: a namespace is a collection of its own

    UNSUPPORTED = ("patch_rows", "patch_columns", "patch_by_filter", "upsert_condition", "patch_condition", "delete_condition", "copy_from_namespace", "encryption", "disable_backpressure")
    DISTANCES = {"cosine_distance": "cosine", "euclidean_squared": "euclidean", "dot_product": "dot", "cosine": "cosine", "euclidean": "euclidean", "dot": "dot"}

    def write(self, name: str, upsert_rows: list[dict] | None = None, upsert_columns: dict | None = None, deletes: list | None = None, delete_by_filter: Any = None, distance_metric: str = "cosine", schema: dict | None = None, **other: Any) -> dict:
        """Deletes first, then upserts. A new namespace takes its dimension from the first vector."""
        if bad := [k for k in other if other[k] is not None]:
            raise InvalidArgument(f"unsupported: {', '.join(bad)}" if all(k in self.UNSUPPORTED for k in bad) else f"unknown: {', '.join(bad)}")
        rows = rows_of(upsert_rows or []) + (columns_of(upsert_columns) if upsert_columns else [])
        if len({r["id"] for r in rows}) != len(rows):
            raise InvalidArgument("an id is written twice")
        result = {"rows_upserted": len(rows), "rows_deleted": 0, "deleted_ids": [str(d) for d in deletes or []]}
        try:
            self.get(name)
        except NotFound:
            if not rows:
                return result | {"deleted_ids": []}
            if distance_metric not in self.DISTANCES:
                raise InvalidArgument(f"unknown distance_metric {distance_metric}") from None
            self.create(name, len(rows[0]["values"]), self.DISTANCES[distance_metric], schema)
        if deletes or delete_by_filter is not None:
            result["rows_deleted"] = self.delete(name, ids=[str(d) for d in deletes or []], where=delete_by_filter)
        if rows:
            self.upsert(name, rows)
        return result

    def ask(self, name: str, rank_by: Any, limit: int | dict = 10, filters: Any = None, include_attributes: bool | list[str] | None = None, exclude_attributes: tuple[str, ...] = ()) -> DataFrame:
        """A namespace query: a vector leaf or a BM25 expression. id, $dist and attributes, in order of rank.

        include_attributes: null or true for all (one VARIANT column), false for none, or a list (a column each).
        """
        k = search.namespace_limit(limit)
        e = rank.parse(rank_by)
        if isinstance(e, rank.VectorLeaf):
            strategy = {"exact": "exact", "knn": "exact", "ann": "ann"}.get(e.strategy, "auto")
            got = self.query(name, list(e.values), k, filters, strategy=strategy)
        else:
            best = [(r.id, r.score) for r in self.search(name, rank_by, k, filters).collect()]  # k rows
            scores = self.spark.createDataFrame(best, "id string, score double")
            got = self.snapshot(name, ids=[i for i, _ in best]).join(F.broadcast(scores), "id").orderBy(F.desc("score"), "id")
        v = Variant(F.col("metadata"))
        if isinstance(include_attributes, list):
            names = [a for a in include_attributes if a not in exclude_attributes]
            return got.select("id", (-F.col("score")).alias("$dist"), *[F.col("values").alias("vector") if a == "vector" else v._item(a).alias(a) for a in names])
        everything = [F.col("values").alias("vector"), F.col("metadata").alias("attributes")] if include_attributes is not False else []
        if everything and exclude_attributes:
            kept = F.map_filter(F.try_variant_get("metadata", "$", "map<string,variant>"), lambda key, _: ~key.isin(*exclude_attributes))
            everything = [*([everything[0]] if "vector" not in exclude_attributes else []), kept.alias("attributes")]
        return got.select("id", (-F.col("score")).alias("$dist"), *everything)

    def ask_all(self, name: str, queries: list[dict]) -> DataFrame:
        """multiQuery: at most 16 queries, told apart by query_index."""
        return search.multi([self.ask(name, **q) for q in queries])

    def inventory(self, prefix: str = "", cursor: str | None = None, limit: int = 200) -> DataFrame:
        """key, category of stored objects after the cursor."""
        keys = [k for k in self.objects.list("") if k.startswith(prefix) and (cursor is None or k > cursor)]
        keys = keys[: min(500, max(1, limit))]
        return self.spark.createDataFrame([(k,) for k in keys], "key string").select("key", t.key_category(F.col("key")).alias("category"))
