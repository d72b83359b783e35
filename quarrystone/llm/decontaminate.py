"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of K-word runs among W neighbours; as
K + W - 1 is the window's length, two equal windows have equal fingerprints.
Document and benchmark fingerprints are joined, and each hit is extended to the
whole window, whose words must be equal. Items that are shorter than a window
are windows of their own length; their fingerprint is their own hash.

A benchmark of at most SMALL bytes goes to the tasks as it is, and documents
are read once, without a shuffle. A larger one is joined by fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, table
from ._text import NOT_ALNUM, Words, grams, mix, sliding_min, words

WINDOW = 13
K, W = 5, 9
#: Bytes of benchmark text and ids that are sent to every task.
SMALL = 32 << 20

SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def fingerprints(w: Words) -> np.ndarray:
    """The fingerprint of the window that begins at each flat word, within() tells which lie in one row."""
    return sliding_min(grams(w, K)[0], W) if len(w.hashes) >= WINDOW else np.zeros(0, np.uint64)


def within(w: Words, n: int) -> np.ndarray:
    """Flat words at which a window of n words of one row begins."""
    end = np.repeat(w.ptr[1:], np.diff(w.ptr))
    return np.flatnonzero(np.arange(len(w.hashes)) + n <= end)


def at(w: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words at the given flat words."""
    out = np.full(len(starts), n, np.uint64)
    for j in range(n):
        out *= np.uint64(0xA24BAED4963EE407)
        out += w.hashes[starts + j]
        out ^= out >> np.uint64(29)
    return mix(out)


class Benchmark:
    """Windows of the items: by length their sorted hashes and the items of each, and the fingerprints of whole windows."""

    def __init__(self, ids: list, texts: pa.Array):
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for w in words(texts, NOT_ALNUM, lower=True):
            size = np.diff(w.ptr)
            row = w.row_of()
            starts = within(w, WINDOW)
            if len(starts):
                found.setdefault(WINDOW, []).append((at(w, starts, WINDOW), row[starts] + w.first))
                prints.append(fingerprints(w)[starts])
            for n in np.unique(size[(size > 0) & (size < WINDOW)]):
                rows = np.flatnonzero(size == n)
                found.setdefault(int(n), []).append((at(w, w.ptr[rows], int(n)), rows + w.first))
        self.ids = [None if x is None else str(x) for x in ids]
        self.prints = np.unique(np.concatenate(prints))
        self.by_length = {}
        for n, parts in found.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], names="h,item"))
            hashes, first = np.unique(pairs["h"], return_index=True)
            self.by_length[n] = (hashes, np.append(first, len(pairs)), pairs["item"])
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.prints & np.uint64(0xFFFF)] = True

    def candidates(self, w: Words) -> np.ndarray:
        prints = fingerprints(w)
        maybe = np.flatnonzero(self.sieve[prints & np.uint64(0xFFFF)])
        maybe = maybe[_has(self.prints, prints[maybe])]
        return maybe[np.isin(maybe, within(w, WINDOW), assume_unique=True)] if len(maybe) else maybe

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, tuple]]:
        """(flat starts, length, index into the windows of this length, the windows)"""
        for n, known in self.by_length.items():
            starts = self.candidates(w) if n == WINDOW else within(w, n)
            if len(starts):
                hashes = at(w, starts, n)
                i = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
                ok = known[0][i] == hashes
                if ok.any():
                    yield starts[ok], n, i[ok], known


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def scan(texts: pa.Array, bench: Benchmark) -> list[pa.Array]:
    """The columns of SCHEMA for a batch of texts."""
    n_words, n_hit, n_items, shas = [], [], [], []
    none = sha_of([])
    for w in words(texts, NOT_ALNUM, lower=True):
        edge = np.zeros(len(w.hashes) + 1, np.int32)
        items: dict[int, set[str]] = {}
        row = None
        for starts, n, i, (_, first, item) in bench.hits(w):
            row = w.row_of() if row is None else row
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + n, -1)
            for r, j in set(zip(row[starts].tolist(), i.tolist(), strict=True)):
                items.setdefault(r, set()).update(bench.ids[k] for k in item[first[j] : first[j + 1]])
        n_words.append(np.diff(w.ptr))
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_hit.append(covered[w.ptr[1:]] - covered[w.ptr[:-1]])
        own = [sorted(x for x in items.get(r, ()) if x is not None) for r in range(w.n)]
        n_items += map(len, own)
        shas += [sha_of(x) if x else none for x in own]
    a = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    b = np.concatenate(n_hit) if n_hit else np.zeros(0, np.int64)
    return [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string()), pa.array((b > 0) & (20 * b >= a), pa.bool_())]


def _by_scan(docs: DataFrame, bench: Benchmark) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vars(bench))  # plain values: they are not pickled like functions
    fields = docs.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark.__new__(Benchmark)
        vars(bench).update(sent.value)
        for b in batches:
            names = [*b.schema.names, *(f.split()[0] for f in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([*b.columns, *scan(b.column("text"), bench)], names)

    return docs.mapInArrow(run, f"{fields}, {SCHEMA}")


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For a benchmark of any size. Rows are told apart by doc_id and a hash of the text; equal rows share a result."""
    keys = ["doc_id", "uid"]

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id").cast(pa.string()).to_pylist()
            for w in words(b.column("text"), NOT_ALNUM, lower=True):
                size, row = np.diff(w.ptr), w.row_of()
                for n in [int(x) for x in np.unique(np.minimum(size, WINDOW)) if x]:
                    starts = within(w, n)
                    starts = starts if n == WINDOW else starts[size[row[starts]] == n]
                    hashes = at(w, starts, n)
                    prints = fingerprints(w)[starts] if n == WINDOW else hashes
                    own = [ids[w.first + r] for r in row[starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array([n] * len(starts), pa.int32()), pa.array(own, pa.string())], ["fp", "wh", "len", "item"])

    known = cut(items.select("item_id", "text").mapInArrow(of_items, "fp long, wh long, len int, item string").distinct(), "bench-windows")
    lengths = sorted(r.len for r in known.select("len").distinct().collect())  # 13 at most

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("text"), NOT_ALNUM, lower=True):
                row, parts, rows = w.row_of(), [], []
                for n in lengths:
                    starts = within(w, n)
                    parts.append(fingerprints(w)[starts] if n == WINDOW else at(w, starts, n))
                    rows.append(row[starts])
                fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                order = np.lexsort((fp, r))
                fp, r = fp[order], r[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (r[1:] != r[:-1])
                fp, r = fp[new].view(np.int64), r[new]
                ends = np.searchsorted(r, np.arange(w.n + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(fp))
                part = slice(w.first, w.first + w.n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[part], b.column("uid")[part], pa.array(np.diff(w.ptr), pa.int64()), lists], ["doc_id", "uid", "n_words", "fps"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = cut(rows.mapInArrow(of_docs, f"doc_id {kind}, uid long, n_words long, fps array<long>"), "doc-prints")
    # as tables: a join of two plain shuffles is one whose hot keys Spark can split
    prints = cut(known.select("fp").distinct(), "bench-prints")
    items_of = cut(known.select("wh", "len", "item").distinct(), "bench-items")
    found = seen.select(*keys, F.explode("fps").alias("fp")).join(prints, "fp", "left_semi")
    found = found.groupBy(*keys).agg(F.collect_set("fp").alias("fps"))
    a, b = rows.dropDuplicates(keys).alias("a"), found.alias("b")
    match = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.uid") == F.col("b.uid"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [np.unique(np.array(s, np.int64).view(np.uint64)) for s in x.column("fps").to_pylist()]
            for w in words(x.column("text"), NOT_ALNUM, lower=True):
                fps = fingerprints(w)
                for r in range(w.n):
                    own, a, b = sets[w.first + r], w.ptr[r], w.ptr[r + 1]
                    for n in lengths:
                        starts = np.arange(a, max(a, b - n + 1))
                        hashes = None if n == WINDOW else at(w, starts, n)
                        starts = starts[_has(own, fps[starts] if n == WINDOW else hashes)]
                        if len(starts):
                            hashes = at(w, starts, n)
                            m = len(starts)
                            one = lambda c, m=m, r=r: pa.array([x.column(c)[w.first + r].as_py()] * m, x.column(c).type)  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays([one("doc_id"), one("uid"), pa.array(hashes.view(np.int64)), pa.array([n] * m, pa.int32()), pa.array(starts - a, pa.int64())], ["doc_id", "uid", "wh", "len", "start"])

    spans = a.join(b, match).select("a.doc_id", "a.uid", "text", "fps").mapInArrow(windows, f"doc_id {kind}, uid long, wh long, len int, start long")
    real = cut(spans.join(items_of, ["wh", "len"]).select(*keys, "len", "start", "item"), "doc-hits")
    each = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "len"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["len"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["start"] + x["len"]).alias("end")),
        lambda s: s["n"],
    )
    per = real.groupBy(*keys).agg(each.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    s, p = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("uid")).alias("s"), per.alias("p")
    counts = seen.select(*keys, "n_words").dropDuplicates(keys).alias("c")
    out = s.join(counts, F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.uid") == F.col("c.uid")))
    out = out.join(p, F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.uid") == F.col("p.uid")), "left")
    items = F.coalesce("p.items", F.array().cast("array<string>"))
    hit = F.coalesce("p.n_hit", F.lit(0)).cast("long")
    return out.select(*[F.col("s.row")[c].alias(c) for c in docs.columns], "c.n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("c.n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, small: int = SMALL) -> DataFrame:
    """docs (doc_id, text and any columns) with n_words, n_hit, n_items, items_sha256, contaminated.

    items: item_id, text. Columns of the added names in docs are replaced. A
    null text has no words; an item without words has no window; items with a
    null id mark words but are not counted or listed; rows of one item_id are
    one item. Repeated documents get equal results; an empty benchmark hits
    nothing. Texts are read whole, the longest ones piece by piece; a document
    at exactly a twentieth counts as contaminated. Windows are compared by
    64-bit hashes of their words.
    """
    docs = docs.drop(*[f.split()[0] for f in SCHEMA.split(", ")])
    items = items.filter(F.coalesce("text", F.lit("")).rlike("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"))  # without a word there is no window
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))).first()[0] or 0
    if size > small:
        return _by_join(docs, items)
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").toArrow()
    texts = rows.column("text").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    return _by_scan(docs, Benchmark(rows.column("item_id").to_pylist(), texts.cast(pa.large_string())))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, {_WORDS} as words from documents
), b as (
  select item_id, {_WORDS} as words from benchmark
), bw as (
  select distinct item_id, least(len(words), {WINDOW}) as n, array_to_string(words[i:i + least(len(words), {WINDOW}) - 1], ' ') as win
  from (select *, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) as i from b where len(words) > 0)
), dw as (
  select r, n, i, array_to_string(words[i:i + n - 1], ' ') as win
  from (select r, words, n, unnest(range(1, len(words) - n + 2)) as i from d, (select distinct n from bw) where len(words) >= n)
), hit as (
  select r, n, i, item_id from dw join bw using (n, win)
), covered as (
  select r, count(distinct w)::bigint as n_hit from (select r, unnest(range(i, i + n)) as w from (select distinct r, n, i from hit)) group by r
), items as (
  select r, count(*)::bigint as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct r, item_id::varchar as item from hit where item_id is not null) group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join covered using (r) left join items using (r)
"""
