"""Near-duplicate detection with SetSketch registers (Ertl, 2021).

Every element of a set draws a Poisson process whose points fall on random
registers, so the first points on the M registers are independent exponential
variables; a register keeps the least over the set, truncated to
floor(1 - log_B x): mergeable, and equal in two sets with a probability close
to their Jaccard similarity. Registers are banded. Documents that share a band
are candidates; the likelihood of the joint registers estimates their
similarity, and pairs near or over the threshold are verified on full sets.

Documents with equal sets form a class and are handled once, by the least
doc_id. Within a band only pairs with a representative are looked at first,
and pairs that are connected already never. What is then left of a band, pairs
of different components, is looked at pair by pair, so no link is lost to a cap;
but first shingles that no other such document has are counted. They bound the
similarity of every pair from above, without looking at it, so families of
documents that differ from one another by more than the threshold fall apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, table
from ._text import WHITE, Words, grams, mix, words
from .components import components

SHINGLE = 5
THRESHOLD = 80
#: Registers, and how many make a band: a pair at 0.8 shares none of the 40 bands with probability 1.2e-7.
M, R = 200, 5
#: Rate and base of the registers.
A, B = 20.0, 1.001
#: How far below the threshold the estimate may be for a pair to be verified (five standard deviations).
MARGIN = 0.15


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of k words; the whole text where it has fewer."""
    h, out = grams(w, k)[0], []
    for i in range(w.n):
        a, b = int(w.ptr[i]), int(w.ptr[i + 1])
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                x = mix(x * np.uint64(0x9E6C63D0876A9A99) + w.hashes[j])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set; sets must not be empty."""
    least = np.full(len(sets) * M, np.inf)
    if not sets:
        return np.zeros((0, M), np.uint16)
    e = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    t, j = np.zeros(len(e)), 0
    while len(e):
        step = max(1, min(j // 2, 500_000 // len(e)))  # bounds the arrays below
        x = mix(e[:, None] + np.arange(j + 1, j + 1 + step, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (A * M)
        reg = (mix(x ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(M)).astype(np.int64)
        at = t[:, None] + np.cumsum(gap, 1)
        np.minimum.at(least, (row[:, None] * M + reg).ravel(), at.ravel())
        t, j = at[:, -1], j + step
        on = t < least.reshape(-1, M).max(1)[row]  # later points of the others can't change a register
        e, row, t = e[on], row[on], t[on]
    return np.clip(np.floor(1 - np.log(least.reshape(-1, M)) / np.log(B)), 0, 65535).astype(np.uint16)


def bands(k: np.ndarray) -> np.ndarray:
    parts = k.reshape(len(k), M // R, R).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, M // R + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(R):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, i])
    return out


def similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of each pair that makes its registers likeliest, given the sizes of the sets."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    u, v = nx / (nx + ny), ny / (nx + ny)
    top = np.minimum(u / v, v / u)
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * (B - 1) / B) / np.log(B)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    like = more[:, None] * np.log(a) + less[:, None] * np.log(b) + (M - more - less)[:, None] * np.log(np.clip(1 - a - b, 1e-12, 1))
    return grid[np.arange(len(grid)), like.argmax(1)]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), WHITE, lower=True):
                sets = shingle_sets(w, k)
                n = np.array([len(s) for s in sets])
                s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64)
                regs = registers([s for s in sets if len(s)])
                full = bands(regs).view(np.int64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * (M // R))])
                sketch = iter(regs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[w.first : w.first + w.n],
                        pa.array(n, pa.int64()),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full.ravel())),
                        pa.array([next(sketch).tobytes() if x else None for x in n], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id, text -> id, set (the sorted hashes as bytes)"""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), WHITE, lower=True):
                yield pa.RecordBatch.from_arrays([batch.column("id")[w.first : w.first + w.n], pa.array([s.tobytes() for s in shingle_sets(w, k)], pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, f"id {kind}, set binary")


def _likely(pairs: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Pairs a, b whose estimate is near or over the threshold. known: id, n, sketch."""
    kind = pairs.schema["a"].dataType.simpleString()
    a = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    both = pairs.join(a, "a").join(b, "b").filter((100 * F.col("na") >= threshold * F.col("nb")) & (100 * F.col("nb") >= threshold * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 2048):
                part = x.slice(i, 2048)
                ka, kb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ka", "kb"))
                est = similarity(ka, kb, part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float))
                yield part.select(["a", "b"]).filter(pa.array(est >= threshold / 100 - MARGIN))

    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for sa, sb in zip(x.column("sa"), x.column("sb"), strict=True):
                u, v = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= threshold * (len(u) + len(v) - both))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _lone(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id, lone: for each of the ids, how many of its shingles no other one of them has."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 256):
                part = x.slice(i, 256)
                got = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column("set")]
                whose = np.repeat(np.arange(len(got)), [len(g) for g in got])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(whose)), pa.array(np.concatenate(got))], ["id", "x"])

    each = sets.join(ids, "id", "left_semi").mapInArrow(run, f"id {kind}, x long")
    once = each.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return ids.join(once.groupBy("id").agg(F.count(F.lit(1)).alias("lone")), "id", "left").select("id", F.coalesce("lone", F.lit(0)).alias("lone"))


def _possible(threshold: int) -> Column:
    """Whether two sets of n and nb shingles, of which s and sb are shared with anything, can be similar enough."""
    both = F.least("s", "sb")
    return 100 * both >= threshold * (F.col("n") + F.col("nb") - both)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Rows are linked if the sets of their shingles of k words (A-Z lowered) have
    a Jaccard similarity of threshold percent or more; component_id is the least
    doc_id that links reach. A text of fewer than k words is one shingle; a null
    text, or one without words, has no shingle and no link. Copies of a row get
    the same component and are all kept or not; rows with equal ids count as one
    document. A null id takes the component of the rows with an equal set and is
    never kept, nor linked otherwise. A similarity of exactly the threshold is
    a link (ties). Texts are read whole, the longest ones piece by piece; a set
    is as large as its text. An empty table gives an empty result.
    """
    seen = cut(_sketches(docs, k), "near-sketches")
    classes = cut(seen.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id")), "near-classes")
    same = ["doc_id", "s1", "s2", "n_shingles"]
    known = seen.join(classes.withColumnRenamed("id", "doc_id"), same).dropDuplicates(same)
    known = cut(known.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands"), "near-known")

    rows = known.select("id", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    member = cut(rows.join(shared.select("band"), "band"), "near-members")  # band, id, n
    ids = member.select("id").distinct()
    sketches = known.select("id", "n", "sketch")
    text = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    sets = cut(_sets(text, k), "near-sets")

    def between(now: DataFrame) -> DataFrame:
        """Only bands whose members aren't connected yet. As tables: a join of two plain shuffles is one whose hot bands Spark can split."""
        bands = cut(now.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("band"), "near-between")
        return cut(now.join(bands, "band", "left_semi"), "near-open")

    component, last = None, False
    for r in range(rounds + 1):
        if component is None:
            now = member.withColumn("c", F.col("id")).withColumn("s", F.col("n"))
        else:
            now = member.join(component, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
            if r == 1:
                now = between(now)
                lone = cut(_lone(sets, now.select("id").distinct()), "near-lone")
                now = now.join(lone, "id").withColumn("s", F.col("n") - F.col("lone")).drop("lone").filter(100 * F.col("s") >= threshold * F.col("n"))
            now = between(now)
            member = now.drop("c")
            if now.isEmpty():
                break
        last = last or r == rounds
        other = [F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb")]
        if last:
            pairs = now.join(now.select("band", *other), "band").filter("c < cb")
        else:
            # a representative for each band: at first each document meets the one it shares most bands with, then
            # the one that has least of its own, and others after it
            order = F.lit(0) if r == 0 else -F.col("s") / F.col("n") if r == 1 else F.xxhash64("id", F.lit(r))
            reps = now.groupBy("band").agg(F.min(F.struct(order.alias("o"), *other)).alias("rep")).select("band", "rep.b", "rep.cb", "rep.nb", "rep.sb")
            pairs = now.join(cut(reps, "near-reps") if r else reps, "band").filter("c != cb")
        pairs = pairs.filter((100 * F.col("n") >= threshold * F.col("nb")) & (100 * F.col("nb") >= threshold * F.col("n")) & _possible(threshold))
        pairs = pairs.groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("times"))
        if r == 0:
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
        # links are few: dealt anew, they come in few files, not in one for each task that verifies
        found = cut(_verified(_likely(pairs.select("a", "b"), sketches, threshold), sets, threshold).repartition("a"), "near-links")
        if component is None:
            component = cut(components(found), "near-components")
        elif not found.isEmpty():
            # the new links join components
            x = component.select(F.col("id").alias("a"), F.col("component").alias("x"))
            y = component.select(F.col("id").alias("b"), F.col("component").alias("y"))
            above = components(found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            above = cut(above.select(F.col("id").alias("old"), F.col("component").alias("new")), "near-above")
            moved = component.join(above, component.component == above.old, "left").select("id", F.coalesce("new", "component").alias("component"))
            fresh = above.join(component, above.old == component.id, "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
            component = cut(moved.unionByName(fresh), "near-components")
        if last:
            break
        last = r > 0 and found.isEmpty()

    to = classes.alias("c").join(component.alias("m"), F.col("c.id") == F.col("m.id"), "left")
    to = to.select("s1", "s2", "n_shingles", F.coalesce("m.component", "c.id").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "s1", "s2").join(to, ["s1", "s2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP10_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents
), s as (
  select distinct doc_id, array_to_string(words[i:i + 1], ' ') as x from (select *, unnest(range(1, greatest(len(words) - 1, 1) + 1)) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), sig as (
  select doc_id, md5(string_agg(x, chr(10) order by x)) as sig from s group by doc_id
), cls as (
  select sig, min(doc_id) as rep from sig group by sig
), r as (
  select s.doc_id, s.x, n.n from s join n using (doc_id) join cls on cls.rep = s.doc_id
), rare as (
  select x, row_number() over (order by count(*), x) as rank from r group by x
), pref as (
  select doc_id, x, n, row_number() over (partition by doc_id order by rank) as p from r join rare using (x)
), cand as (
  select distinct a.doc_id as a, b.doc_id as b from pref a join pref b on a.x = b.x and a.doc_id < b.doc_id
  where a.p <= a.n - ceil(0.8 * a.n) + 1 and b.p <= b.n - ceil(0.8 * b.n) + 1 and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
), inter as (
  select a, b, count(*) as c from cand join r ra on ra.doc_id = a join r rb on rb.doc_id = b and rb.x = ra.x group by a, b
), link as (
  select a, b from inter join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
), edge as (
  select a, b from link union select b, a from link
), reach(id, to_) as (
  select rep, rep from cls union select reach.id, edge.b from reach join edge on edge.a = reach.to_
), comp as (
  select id, min(to_) as component from reach group by id
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.component, w.doc_id)::bigint as component_id, coalesce(comp.component, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join sig using (doc_id) left join cls using (sig) left join comp on comp.id = cls.rep
"""
