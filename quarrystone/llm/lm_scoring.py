"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word is drawn in the restaurant of the word before it. There is a
restaurant for every word of the training texts, and each has every word as a
dish. All share a parent, the restaurant of single words, where a table is a
customer; its base is uniform over the vocabulary and one unknown word. All
probabilities of a context sum to one.

Seating is sampled by Gibbs sweeps (seating.py): the tables of a pair of words
are drawn from their conditional given all others, its own tables excluded, and
discounts and strengths of both levels are drawn after each sweep. Predictive
probabilities are means over the sweeps after BURN_IN.

Everything that is gathered grows with the corpus and stays distributed. The
LOOKUP most frequent words have numbers, known to every task; the others go by
hashes. Pairs are dealt to buckets, those of a rarer context by that word, so
its restaurant is whole in one task, those of a looked-up one by both words;
the tables of its restaurant are summed over all tasks after each sweep, as are
the parent's customers. Within a sweep a task sees its own changes and the
others' as of the sweep before. Rarer words of equal counts share one number of
customers in the parent, their mean.

Texts are cut into chunks of about CHUNK words. Words, pairs and what is asked
of them move as packed arrays of a chunk for a bucket, not as rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seating
from ._io import forget, settled, table
from ._text import WHITE, mix, words
from .quality_model import held_out

#: So many most frequent words go to the tasks as numbers (16 bytes each, and 8 for each sweep).
LOOKUP = 1 << 18
#: Pairs of two words among so many most frequent ones are looked up in a table of this size squared, so no bucket is asked for them by all texts.
GRID = 1024
SWEEPS, BURN_IN = 8, 4
#: Words of a chunk (and what the last text has beyond).
CHUNK = 1 << 18
#: Training words for each bucket.
BUCKET = 2_000_000
END = np.uint64(0x0EADBEEF0EADBEEF)
TOP = np.uint64(1 << 63)
#: Counts go by steps: each up to EACH, then of two hundredths.
EACH = 1024
SLICE = 8192
#: What tasks count: tables by context, customers by word, tables of rarer contexts, dishes by customers and tables.
BY_CONTEXT, BY_WORD, OPENED, CELLS = range(4)
STATS = "array<struct<s:bigint,data:binary>>"


def step(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c)
    return np.where(c <= EACH, c, np.floor(np.log(np.maximum(c, 1) / EACH) / np.log(1.02)) + EACH).astype(np.int64)


def of_step(s: np.ndarray) -> np.ndarray:
    """A number of this step."""
    return np.where(s <= EACH, s, np.round(EACH * 1.02 ** (s - EACH + 0.5)))


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in as few bytes as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, as they compress best."""
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    body = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    raw = b"".join([len(head).to_bytes(4, "little"), head, *body])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and its places, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    first = runs(bucket[order])
    for a, z in zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:z]


def bucket_of_words(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(buckets)).astype(np.int32)


def pair_key(ku: np.ndarray, kw: np.ndarray) -> np.ndarray:
    return mix(ku * np.uint64(0xD1342543DE82EF95) + kw)


def bucket_of_pairs(ku: np.ndarray, kw: np.ndarray, buckets: int) -> np.ndarray:
    return (np.where(ku < TOP, pair_key(ku, kw), mix(ku)) % np.uint64(buckets)).astype(np.int32)


def found(table_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table, and whether they are there."""
    if not len(table_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return i, table_[i] == x


def counted(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> list[dict]:
    """kind, places and numbers -> packed slices of sums."""
    out = []
    for kind, i, x in parts:
        at, whose = np.unique(i, return_inverse=True)
        total = np.bincount(whose, x, len(at)) if len(at) else np.zeros(0)
        at, total = at[total != 0], total[total != 0]
        for s, places in dealt(at // SLICE):
            out.append({"s": (kind << 40) + s, "data": pack((at[places] % SLICE).astype(np.uint16), total[places])})
    return out


def added(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of what tasks counted: by kind the places and the numbers. A few numbers for each looked-up word and step at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(lambda: np.zeros(SLICE))
        for b in batches:
            for s, data in zip(b.column("s").to_pylist(), b.column("data").to_pylist(), strict=True):
                i, x = unpack(data)
                total[s][i] += x  # places are distinct
        for s, x in total.items():
            i = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([pack(i.astype(np.uint16), x[i])], pa.binary())], ["s", "data"])

    form = "s long, data binary"
    # summed within tasks, then over groups of tasks, then over all
    got = rows.select(F.explode("stats").alias("x")).select("x.*").mapInArrow(run, form)
    got = got.repartition("s", F.spark_partition_id() % 32).mapInArrow(run, form).repartition("s").mapInArrow(run, form).toArrow()
    parts = defaultdict(list)
    for s, data in sorted(zip(got.column("s").to_pylist(), got.column("data").to_pylist(), strict=True)):
        i, x = unpack(data)
        parts[s >> 40].append((i.astype(np.int64) + (s & ((1 << 40) - 1)) * SLICE, x))
    return {k: tuple(map(np.concatenate, zip(*v, strict=True))) for k, v in parts.items()}


def dense(sums: dict, kind: int, n: int) -> np.ndarray:
    out = np.zeros(n)
    if kind in sums:
        i, x = sums[kind]
        out[i] = x
    return out


@dataclass
class Lookup:
    """What tasks know of all words: n training words in all, v different ones; hashes (sorted) of the looked-up ones and their ranks by count."""

    n: int
    v: int
    hashes: np.ndarray
    rank: np.ndarray
    count: np.ndarray  # by rank

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Ranks of looked-up words; hashes with the top bit set of others."""
        i, there = found(self.hashes, h)
        return np.where(there, self.rank[i].astype(np.uint64) if len(self.rank) else np.uint64(0), h | TOP)


@dataclass
class State:
    """The model after a sweep. tables: by rank of the context; p: the parent's probability by rank of the word, then by step of a rarer word's count."""

    d: float
    theta: float
    tables: np.ndarray
    p: np.ndarray


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """docs: row, learn, text -> chunks of rows: the size of each and whether it's learned from, its words as places in the chunk's list, and that list with training counts."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def out() -> pa.RecordBatch:
            nonlocal at, held, n
            flat, sizes, learn = (np.concatenate([x[i] for x in held]) for i in range(3))
            rows = pa.concat_arrays([x[3] for x in held])
            h, idx, count = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            to = np.empty(len(h), np.int64)
            to[order] = np.arange(len(h))
            idx = to[idx]
            train = np.bincount(idx[np.repeat(learn, sizes)], minlength=len(h))
            made = pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([int(train.sum())]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *(pa.array([x], pa.binary()) for x in (pack(small(sizes), learn), pack(small(idx)), pack(h[order], small(train))))],
                ["chunk", "n", "rows", "sizes", "tokens", "words"],
            )
            at, held, n = at + 1, [], 0
            return made

        for b in batches:
            learn = b.column("learn").fill_null(False).to_numpy(zero_copy_only=False)
            for w in words(b.column("text"), WHITE, lower=True):
                part = slice(w.first, w.first + w.n)
                held.append((np.insert(w.hashes, w.ptr[1:], END), np.diff(w.ptr) + 1, learn[part], b.column("row")[part]))
                n += len(w.hashes)
                if n >= chunk:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, f"chunk long, n long, rows array<{kind}>, sizes binary, tokens binary, words binary")


def _words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Training counts: of a bucket's words (chunk is null), and of the words of a bucket that each chunk has, in the chunk's order."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist(), strict=True):
                h, train = unpack(data)
                got = [(k, pack(h[i], small(train[i]))) for k, i in dealt(bucket_of_words(h, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([chunk] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], ["b", "chunk", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for k, chunk, data in zip(*(b.column(x).to_pylist() for x in ("b", "chunk", "data")), strict=True):
                held[k].append((chunk, data))
        for k, parts in held.items():
            got = [unpack(x) for _, x in parts]
            h, whose = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            total = np.bincount(whose, np.concatenate([x[1] for x in got]).astype(float), len(h)).astype(np.int64)
            seen = total > 0
            ends = np.cumsum([len(x[0]) for x in got])
            back = [pack(small(total[whose[z - len(x[0]) : z]])) for x, z in zip(got, ends, strict=True)]
            data = [pack(h[seen], total[seen]), *back]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(data), pa.int32()), pa.array([None, *(c for c, _ in parts)], pa.int64()), pa.array(data, pa.binary())], ["b", "chunk", "data"])

    form = "b int, chunk long, data binary"
    return chunks.select("chunk", "words").mapInArrow(asked, form).repartitionById(buckets, F.col("b")).mapInArrow(summed, form)


def _lookup(vocabulary: DataFrame, lookup: int) -> tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]:
    """The looked-up words; the steps of counts, how many words have each, and how many times they occur."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                c = unpack(data)[1]
                s, at = np.unique(step(c), return_inverse=True)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.bincount(at)), pa.array(np.bincount(at, c).astype(np.int64))], ["s", "n", "c"])

    got = vocabulary.mapInArrow(steps, "s long, n long, c long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).orderBy("s").toArrow()  # some thousand rows at most
    s, n, c = (got.column(x).to_numpy() for x in ("s", "n", "c"))
    # all words above the step at which there would be too many
    above = np.cumsum(n[::-1])[::-1]
    cutoff = int(s[above > lookup].max()) if (above > lookup).any() else 0

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                h, c = unpack(data)
                at = np.flatnonzero(step(c) > cutoff)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at])], ["h", "c"])

    got = vocabulary.mapInArrow(top, "h long, c long").toArrow()  # lookup rows at most
    h, count = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.lexsort((h, -count))
    h, count = h[order], count[order]
    by = np.argsort(h)
    rare = s <= cutoff
    return Lookup(int(c.sum()), int(n.sum()), h[by], by, count), s[rare], n[rare], c[rare], (of_step(s), n)


def _coded(chunks: DataFrame, answers: DataFrame, look: Lookup, buckets: int) -> DataFrame:
    """Chunks with their words by rank or hash and the steps of their counts, and what can be told of rows from single words."""
    sent = chunks.sparkSession.sparkContext.broadcast(vars(look))
    kind = chunks.schema["rows"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(**sent.value)
        floor = np.log10(look.n + look.v + 1)
        for b in batches:
            for r in range(b.num_rows):
                (sizes, learn), (idx,), (h, _) = (unpack(b.column(x)[r].as_py()) for x in ("sizes", "tokens", "words"))
                total = np.zeros(len(h), np.int64)
                known = {x["b"]: x["data"] for x in b.column("answers")[r].as_py()}
                for k, i in dealt(bucket_of_words(h, buckets)):
                    total[i] = unpack(known[k])[0]
                key = look.keys(h)
                order = np.argsort(key)
                to = np.empty(len(h), np.int64)
                to[order] = np.arange(len(h))
                cls = np.where(key < TOP, 0, step(total))
                begins = np.cumsum(sizes.astype(np.int64)) - sizes
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                n_known = np.add.reduceat((total > 0)[idx].astype(np.int64), begins)
                base = np.add.reduceat(np.log10(total + 1)[idx], begins) - sizes * floor
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk")[r : r + 1], b.column("n")[r : r + 1], b.column("rows")[r : r + 1], lists(sizes.astype(np.int64)), lists(n_known), lists(base), b.column("sizes")[r : r + 1], *(pa.array([x], pa.binary()) for x in (pack(small(to[idx])), pack(key[order], small(cls[order]))))],
                    ["chunk", "n", "rows", "n_tokens", "known", "base", "sizes", "tokens", "words"],
                )

    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("b", "data")).alias("answers"))
    # a bucket's share of chunks at once
    both = chunks.repartition(buckets, "chunk").join(by_chunk.repartition(buckets, "chunk"), "chunk")
    return both.mapInArrow(run, f"chunk long, n long, rows {kind}, n_tokens array<long>, known array<long>, base array<double>, sizes binary, tokens binary, words binary")


def _pairs(coded: DataFrame, look: Lookup, buckets: int) -> DataFrame:
    """Pairs of training words by bucket: those that occur once (many is false), and others with counts and one table each; and what the first sweep needs to know."""
    size = len(look.count)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (sizes, learn), (idx,), (key, cls) = (unpack(b.column(x)[r].as_py()) for x in ("sizes", "tokens", "words"))
                idx = idx.astype(np.int64)
                at = np.flatnonzero(np.repeat(learn, sizes))
                both, c = np.unique(np.concatenate([idx[-1:], idx[:-1]])[at] * len(key) + idx[at], return_counts=True)
                u, w = both // len(key), both % len(key)
                got = [(k, pack(key[u[i]], key[w[i]], cls[w[i]], small(c[i]))) for k, i in dealt(bucket_of_pairs(key[u], key[w], buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["b", "data"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for k, data in zip(b.column("b").to_pylist(), b.column("data").to_pylist(), strict=True):
                held[k].append(data)
        for k, blobs in held.items():
            u, w, cls, c = map(np.concatenate, zip(*map(unpack, blobs), strict=True))
            order = np.lexsort((w, u))
            u, w, cls, c = u[order], w[order], cls[order], c[order].astype(np.int64)
            first = np.union1d(runs(u), runs(w)).astype(np.int64)
            u, w, cls, c = u[first], w[first], cls[first], np.add.reduceat(c, first)
            one = c == 1
            code = np.where(w < TOP, w, size + cls.astype(np.uint64)).astype(np.int64)
            # tables of restaurants without a pair that occurs twice never change
            context = runs(u)
            pairs = np.diff(context, append=len(u))
            ones = np.add.reduceat(one.astype(np.int64), context)
            rare = u[context] >= TOP
            fixed = rare & (ones == pairs)
            hot = u < TOP
            stats = counted([(BY_CONTEXT, u[hot].astype(np.int64), np.ones(int(hot.sum()))), (BY_WORD, code, np.ones(len(u))), (OPENED, step(ones[fixed]), np.ones(int(fixed.sum())))])
            of = np.repeat(np.where(rare, ones, 0), pairs)
            m = ~one
            data = [pack(u[one], w[one], small(cls[one])), pack(u[m], w[m], small(cls[m]), small(c[m]), small(of[m]), np.ones(int(m.sum()), np.uint8))]
            yield pa.RecordBatch.from_arrays([pa.array([k] * 2, pa.int32()), pa.array([False, True]), pa.array(data, pa.binary()), pa.array([stats, []], pa.list_(pa.struct([("s", pa.int64()), ("data", pa.binary())])))], ["b", "many", "data", "stats"])

    got = coded.filter("n > 0").select("sizes", "tokens", "words").mapInArrow(seen, "b int, data binary")
    return got.repartitionById(buckets, F.col("b")).mapInArrow(whole, f"b int, many boolean, data binary, stats {STATS}")


def _seated(many: DataFrame, state: State, number: int, keep: bool) -> DataFrame:
    """The pairs with their tables after one more sweep (kept beside, if wanted), and what they now come to."""
    spark = many.sparkSession
    sent = spark.sparkContext.broadcast(vars(state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(**sent.value)
        size = len(state.tables)
        for b in batches:
            for k, data in zip(b.column("b").to_pylist(), b.column("data").to_pylist(), strict=True):
                u, w, cls, c, ones, t, *kept = unpack(data)
                context = runs(u)
                whose = np.repeat(np.arange(len(context)), np.diff(context, append=len(u)))
                hot = u < TOP
                code = np.where(w < TOP, w, size + cls.astype(np.uint64)).astype(np.int64)
                total = np.bincount(whose, t, len(context)) + ones[context]
                at = hot[context]
                total[at] = state.tables[u[context][at].astype(np.int64)]
                t = seating.sweep(c.astype(np.int64), t, whose, total, state.p[code], state.d, state.theta, np.random.default_rng([17, number, k]))
                cell, times = np.unique(step(c) * 4096 + step(t), return_counts=True)
                stats = counted([(BY_CONTEXT, u[hot].astype(np.int64), t[hot] - 1), (BY_WORD, code, t - 1), (OPENED, step(np.maximum(total[~at], 1)), np.ones(int((~at).sum()))), (CELLS, cell, times)])
                kept = [*kept, small(t)] if keep else kept
                row = [pa.array([k], pa.int32()), pa.array([pack(u, w, cls, c, ones, small(t), *kept)], pa.binary()), pa.array([stats], pa.list_(pa.struct([("s", pa.int64()), ("data", pa.binary())])))]
                yield pa.RecordBatch.from_arrays(row, ["b", "data", "stats"])

    out = settled(many.select("b", "data").mapInArrow(run, f"b int, data binary, stats {STATS}"), "lm-seated")
    sent.destroy()
    return out


@dataclass
class Parent:
    """The restaurant of single words. Rarer words of a step have the same mean number of customers."""

    v: int
    size: int
    steps: np.ndarray  # of rarer words
    number: np.ndarray  # of words of each
    d: float = 0.5
    theta: float = 1.0
    t: np.ndarray | None = None  # tables by rank
    t_rare: np.ndarray | None = None  # mean tables by step

    CHAINS = 32

    def sweep(self, customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Draws tables and parameters given the customers by rank and step; the probabilities by rank and step (0: the unknown word)."""
        c, sums = customers[: self.size], customers[self.size :]
        mean = sums[self.steps] / np.maximum(self.number, 1)
        if self.t is None:
            self.t, self.t_rare = np.minimum(c, 1), np.minimum(mean, 1)
        self.t = np.minimum(self.t, c)
        base = 1 / (self.v + 1)
        whole = np.array([self.t.sum() + (self.t_rare * self.number).sum()])
        at = np.flatnonzero(c > 1)
        self.t[at] = seating.sweep(c[at], self.t[at], np.zeros(len(at), np.int64), whole, np.full(len(at), base), self.d, self.theta, rng)
        # a mean between two whole numbers is a mixture of both
        low = np.maximum(np.floor(mean), 1)
        share = np.clip(mean - low, 0, 1)
        guests = np.repeat(np.concatenate([low, low + 1]), self.CHAINS)
        drawn = seating.tables(guests, np.full(len(guests), whole[0]), np.full(len(guests), base), self.d, self.theta, rng).reshape(2, -1, self.CHAINS)
        self.t_rare = (1 - share) * drawn[0].mean(1) + share * drawn[1].mean(1)
        opened = self.t.sum() + (self.t_rare * self.number).sum()
        total = customers.sum()
        weight = np.concatenate([(1 - share) * self.number, share * self.number]).repeat(self.CHAINS) / self.CHAINS
        cells = np.concatenate([c[at], guests]), np.concatenate([self.t[at], drawn.ravel()]), np.concatenate([np.ones(len(at)), weight])
        cells = tuple(x[(cells[0] > 1) & (cells[2] > 0)] for x in cells)
        if total > 1:
            self.d, self.theta = seating.parameters(self.d, self.theta, ([max(opened, 1)], [1]), ([total], [1]), cells, rng)
        new = (self.theta + self.d * opened) * base
        p = np.full(len(customers), new)
        p[: self.size] += c - self.d * self.t
        p[self.size + self.steps] += mean - self.d * self.t_rare
        return p / (self.theta + total)


@dataclass
class Predictor:
    """What tasks know for predictions, for each sweep that is averaged over: parameters, weights of new tables, the parent's probabilities; and the grid."""

    d: np.ndarray
    theta: np.ndarray
    new: np.ndarray  # sweeps x ranks
    inverse: np.ndarray  # 1 / (strength + count), sweeps x ranks
    p: np.ndarray  # sweeps x codes
    grid: np.ndarray  # log10 probabilities of words in contexts, both by rank


def predictor(look: Lookup, states: list[State]) -> Predictor:
    d, theta = (np.array([getattr(s, x) for s in states]) for x in ("d", "theta"))
    inverse = 1 / (theta[:, None] + look.count[None, :])
    new = (theta[:, None] + d[:, None] * np.stack([s.tables for s in states])) * inverse
    p = np.stack([s.p for s in states])
    m = min(GRID, len(look.count))
    grid = np.mean([new[i, :m, None] * p[i, None, :m] for i in range(len(states))], 0)
    return Predictor(d, theta, new.astype(np.float32), inverse.astype(np.float32), p.astype(np.float32), grid)


def own_part(c: np.ndarray, kept: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """Customers less discounts, sweeps x pairs."""
    return c[None, :] - d[:, None] * np.stack(kept)


@dataclass
class Fitted:
    look: Lookup
    states: list[State]
    ones: DataFrame  # b, data: u, w, cls
    many: DataFrame  # b, data: u, w, cls, c, ones, t and tables in each state
    buckets: int


def fit(coded: DataFrame, look: Lookup, rare: tuple, counts: tuple, sweeps: int, burn_in: int) -> Fitted:
    """coded: chunks; rare: steps, numbers and occurrences of rarer words; counts: of all words, and how many have them."""
    size = len(look.count)
    codes = size + int(step(np.array([max(look.n, 1)]))[0]) + 1
    buckets = bucket_count(coded.sparkSession, look.n)
    pairs = settled(_pairs(coded, look, buckets), "lm-pairs")
    fixed = added(pairs)
    tables, customers = dense(fixed, BY_CONTEXT, size), dense(fixed, BY_WORD, codes)
    parent, rng = Parent(look.v, size, rare[0], rare[1]), np.random.default_rng(3)
    d, theta, states = 0.5, 1.0, []
    many, first = pairs.filter("many").select("b", "data"), None
    p = parent.sweep(customers, rng)
    for number in range(sweeps):
        seated = _seated(many, State(d, theta, tables, p), number, number >= burn_in)
        got = added(seated)
        tables = dense(fixed, BY_CONTEXT, size) + dense(got, BY_CONTEXT, size)
        p = parent.sweep(dense(fixed, BY_WORD, codes) + dense(got, BY_WORD, codes), rng)
        # restaurants by their tables: looked-up ones, those that never change, and the others
        looked, at = np.unique(tables[tables > 0], return_counts=True)
        opened = [(looked, at), *((of_step(x[OPENED][0]), x[OPENED][1]) for x in (fixed, got) if OPENED in x)]
        cell, times = got.get(CELLS, (np.zeros(0, np.int64), np.zeros(0)))
        d, theta = seating.parameters(d, theta, tuple(map(np.concatenate, zip(*opened, strict=True))), counts, (of_step(cell // 4096), of_step(cell % 4096), times), rng)
        if number >= burn_in:
            states.append(State(d, theta, tables, p))
        if first is not None:
            forget(first)
        many, first = seated.select("b", "data"), seated
    return Fitted(look, states, pairs.filter("not many").select("b", "data"), many, buckets)


def bucket_count(spark: SparkSession, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET)


def _predictor(fitted: Fitted) -> Predictor:
    """With the grid of the most frequent words: GRID**2 numbers at most."""
    pred = predictor(fitted.look, fitted.states)
    m = len(pred.grid)
    d, theta, count = pred.d, pred.theta, fitted.look.count

    def cells(many: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column("data").to_pylist():
                    u, w, _, *rest = unpack(data)
                    at = np.flatnonzero((u < m) & (w < m))
                    u, w = u[at].astype(np.int64), w[at].astype(np.int64)
                    own = own_part(rest[0][at].astype(float), [x[at] for x in rest[3:]], d) if many else np.repeat((1 - d)[:, None], len(at), 1)
                    x = (own / (theta[:, None] + count[u][None, :])).mean(0)
                    yield pa.RecordBatch.from_arrays([pa.array((u * m + w).astype(np.int32)), pa.array(x)], ["cell", "x"])

        return run

    if m:
        got = fitted.ones.mapInArrow(cells(False), "cell int, x double").unionByName(fitted.many.mapInArrow(cells(True), "cell int, x double")).toArrow()
        pred.grid.ravel()[got.column("cell").to_numpy()] += got.column("x").to_numpy()
    pred.grid = np.log10(pred.grid).astype(np.float32)
    return pred


def _asks(coded: DataFrame, m: int, sent, buckets: int) -> DataFrame:
    """What chunks ask of buckets: pairs, and for each of them rows and times. What the grid knows of the rows goes to a bucket as an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = sent.value["grid"]
        for b in batches:
            for r in range(b.num_rows):
                chunk = b.column("chunk")[r].as_py()
                (sizes, _), (idx,), (key, cls) = (unpack(b.column(x)[r].as_py()) for x in ("sizes", "tokens", "words"))
                w = idx.astype(np.int64)
                u = np.concatenate([w[-1:], w[:-1]])
                row = np.repeat(np.arange(len(sizes)), sizes)
                known = int(np.searchsorted(key, np.uint64(m)))  # keys below are ranks below m
                direct = (u < known) & (w < known)
                i = np.flatnonzero(direct)
                sums = np.bincount(row[i], grid[key[u[i]].astype(np.int64), key[w[i]].astype(np.int64)], len(sizes))
                i = np.flatnonzero(~direct)
                both, times = np.unique((u[i] * len(key) + w[i]) * len(sizes) + row[i], return_counts=True)
                row, both = both % len(sizes), both // len(sizes)
                first = runs(both)
                n = np.diff(first, append=len(both))
                u, w = both[first] // len(key), both[first] % len(key)
                got = [(int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), True, pack(np.array([len(sizes)]), sums))]
                for k, at in dealt(bucket_of_pairs(key[u], key[w], buckets)):
                    entries = np.repeat(first[at] - np.cumsum(n[at]) + n[at], n[at]) + np.arange(int(n[at].sum()))
                    got.append((k, False, pack(key[u[at]], key[w[at]], cls[w[at]], small(n[at]), small(row[entries]), small(times[entries]), np.array([len(sizes)]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([chunk] * len(got), pa.int64()), pa.array([x[1] for x in got]), pa.array([x[2] for x in got], pa.binary())], ["b", "chunk", "many", "data"])

    return coded.select("chunk", "sizes", "tokens", "words").mapInArrow(run, "b int, chunk long, many boolean, data binary")


def answered(ones: list[bytes], many: list[bytes], size: int, pred: Predictor):
    """A function that gives the log10 probabilities of pairs of a bucket: u, w, cls -> numbers."""
    d, theta = pred.d, pred.theta
    a = [unpack(x) for x in ones] or [[np.zeros(0, np.uint64)] * 2]
    b = [unpack(x) for x in many]
    u1, w1 = (np.concatenate([x[i] for x in a]) for i in range(2))
    u2, w2 = (np.concatenate([x[i] for x in b] or [np.zeros(0, np.uint64)]) for i in range(2))
    c2 = np.concatenate([x[3] for x in b] or [np.zeros(0)]).astype(float)
    own2 = np.concatenate([own_part(x[3].astype(float), x[6:], d) for x in b] or [np.zeros((len(d), 0))], 1)
    t2 = np.concatenate([np.stack(x[6:]) for x in b] or [np.zeros((len(d), 0))], 1).astype(float)
    key = np.concatenate([pair_key(u1, w1), pair_key(u2, w2)])
    order = np.argsort(key)
    key = key[order]
    # customers and tables of the rarer contexts, all of whose pairs are here
    rare1, rare2 = u1 >= TOP, u2 >= TOP
    context = np.unique(np.concatenate([u1[rare1], u2[rare2]]))
    at1, at2 = np.searchsorted(context, u1[rare1]), np.searchsorted(context, u2[rare2])
    guests = np.bincount(at1, minlength=len(context)) + np.bincount(at2, c2[rare2], len(context))
    inverse = 1 / (theta[:, None] + guests[None, :])
    opened = np.bincount(at1, minlength=len(context))[None, :] + np.stack([np.bincount(at2, t[rare2], len(context)) for t in t2]) if len(d) else inverse
    new = (theta[:, None] + d[:, None] * opened) * inverse

    def ask(u: np.ndarray, w: np.ndarray, cls: np.ndarray) -> np.ndarray:
        code = np.where(w < TOP, w, size + cls.astype(np.uint64)).astype(np.int64)
        fresh, inv = np.ones((len(d), len(u))), np.zeros((len(d), len(u)))
        hot = np.flatnonzero(u < TOP)
        ranks = u[hot].astype(np.int64)
        fresh[:, hot], inv[:, hot] = pred.new[:, ranks], pred.inverse[:, ranks]
        rare = np.flatnonzero(u >= TOP)
        i, there = found(context, u[rare])
        rare, i = rare[there], i[there]
        fresh[:, rare], inv[:, rare] = new[:, i], inverse[:, i]
        p = fresh * pred.p[:, code]
        i, there = found(key, pair_key(u, w))
        at = order[i[there]]
        once = at < len(u1)
        hit = np.flatnonzero(there)
        p[:, hit[once]] += (1 - d)[:, None] * inv[:, hit[once]]
        p[:, hit[~once]] += own2[:, at[~once] - len(u1)] * inv[:, hit[~once]]
        return np.log10(p.mean(0))

    return ask


def _scores(coded: DataFrame, fitted: Fitted) -> DataFrame:
    """chunk, score: of each row of the chunk."""
    spark, size, buckets = coded.sparkSession, len(fitted.look.count), fitted.buckets
    pred = _predictor(fitted)
    sent = spark.sparkContext.broadcast(vars(pred))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pred = Predictor(**sent.value)
        asks, known = defaultdict(list), {False: defaultdict(list), True: defaultdict(list)}
        for b in batches:
            for k, chunk, many, data in zip(*(b.column(x).to_pylist() for x in ("b", "chunk", "many", "data")), strict=True):
                if chunk is None:
                    known[many][k].append(data)
                elif many:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([data], pa.binary())], ["chunk", "data"])
                else:
                    asks[k].append((chunk, data))
        for k, parts in asks.items():
            ask = answered(known[False][k], known[True][k], size, pred)
            for chunk, data in parts:
                u, w, cls, n, row, times, rows = unpack(data)
                total = np.bincount(row, np.repeat(ask(u, w, cls), n) * times, int(rows[0]))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([pack(rows, total)], pa.binary())], ["chunk", "data"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = unpack(data)[1]
                held[chunk] = held[chunk] + x if chunk in held else x
        for chunk, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], ["chunk", "score"])

    asks = _asks(coded, len(pred.grid), sent, buckets)
    model = [x.select("b", F.lit(None).cast("long").alias("chunk"), F.lit(many).alias("many"), "data") for many, x in ((False, fitted.ones), (True, fitted.many))]
    both = asks.unionByName(model[0]).unionByName(model[1])
    return both.repartitionById(buckets, F.col("b")).mapInArrow(run, "chunk long, data binary").repartition("chunk").mapInArrow(gathered, "chunk long, score array<double>")


def learned(docs: DataFrame, learn: str, lookup: int = LOOKUP, chunk: int = CHUNK, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[DataFrame, Fitted]:
    """The chunks of docs, and the model of those rows that the column `learn` names."""
    spark, names = docs.sparkSession, [c for c in docs.columns if c != "text"]
    chunks = settled(_chunks(docs.select(F.struct(*names).alias("row"), F.col(learn).alias("learn"), "text"), chunk), "lm-chunks")
    buckets = bucket_count(spark, chunks.agg(F.sum("n")).first()[0] or 0)
    by_word = settled(_words(chunks, buckets), "lm-words")
    look, *rare, counts = _lookup(by_word.filter("chunk is null").select("data"), lookup)
    coded = settled(_coded(chunks, by_word.filter("chunk is not null"), look, buckets), "lm-coded")
    forget(chunks, by_word)
    return coded, fit(coded, look, rare, counts, sweeps, burn_in)


def scored(docs: DataFrame, learn: str, **options) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score, besides the columns of docs but text, for every row of docs.

    docs: text, the boolean column `learn` that says which rows are learned
    from (null: not), and any other columns, which win over added ones of the
    same name. Words are lowered (A-Z); a null or empty text is one end.
    Repeated rows get equal scores. Without training texts every word is
    unknown and both scores are 0; an empty table gives an empty result. A text
    is in one chunk, however long. Words of equal count (ties) are looked up
    all or none. Words are told apart by 63 bits of hashes.
    """
    names = [c for c in docs.columns if c != "text"]
    coded, fitted = learned(docs, learn, **options)
    columns = ["rows", "n_tokens", "known", "base", "score"]
    got = coded.select("chunk", *columns[:-1]).join(_scores(coded, fitted), "chunk").select(F.inline(F.arrays_zip(*columns)))
    values = {
        "n_tokens": F.col("n_tokens"),
        "n_known": F.col("known"),
        "train_tokens": F.lit(fitted.look.n).cast("long"),
        "base_score": F.col("base"),
        "score": F.col("score"),
    }
    return got.select(*[F.col("rows")[c].alias(c) for c in names], *[x.alias(c) for c, x in values.items() if c not in names])


def score(docs: DataFrame, train: DataFrame, **options) -> DataFrame:
    """scored() for docs, learned from train (text), which may be other texts."""
    names = [c for c in docs.columns if c != "text"]
    row = F.struct(*names)
    kind = docs.select(row.alias("row")).schema["row"].dataType
    both = docs.select(row.alias("row"), "text", F.lit(False).alias("learn")).unionByName(train.select(F.lit(None).cast(kind).alias("row"), "text", F.lit(True).alias("learn")))
    got = scored(both, "learn", **options).filter("not learn")
    return got.select(*[F.col("row")[c].alias(c) for c in names], *[c for c in got.columns[2:] if c not in names])


def op6_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    return scored(docs.withColumn("learn", ~F.col("held_out")), "learn").drop("learn")
