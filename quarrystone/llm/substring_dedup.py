"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: the least hash of K-word runs within each window of
WINDOW words, so equal windows hold equal anchors at equal places. Anchors that
occur twice are joined back to their documents, and only windows around such
anchors are extended to their full length on both sides and compared; windows
that occur twice, merged, are the maximal repeats of WINDOW words or more.

Texts with the same words form a class and are handled once: if there are two
or more of at least WINDOW words, all their windows repeat. Large groups are
therefore counted, never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, table
from ._text import WHITE, Words, grams, mix, sliding_min, words
from ._text import _powers as powers
from .decontaminate import _has, at, within

WINDOW = 35
K = 8


def anchor_of(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, flat starts of the windows, and the anchor's hash of each."""
    starts = within(w, window)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(0, np.uint64)
    h = grams(w, k)[0]
    return h, starts, sliding_min(h, window - k + 1)[starts]


def anchors(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of all runs that are the least of some window (ties too), and their hashes."""
    h, starts, least = anchor_of(w, window, k)
    if not len(starts):
        return starts, least
    reach = window - k + 1
    # a run is an anchor if the greatest of the minima of the windows around it is its own hash
    value = np.zeros(len(h) + reach - 1, np.uint64)
    value[starts + reach - 1] = least
    top = ~sliding_min(~value, reach)
    chosen = np.flatnonzero(top == h)
    chosen = chosen[h[chosen] > 0]
    return chosen, h[chosen]


def sequence_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's sequence of words."""
    place = np.arange(len(w.hashes)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))
    most = int(place.max()) + 1 if len(place) else 1
    out = []
    for base, salt in ((0x5851F42D4C957F2D, 0), (0x14057B7EF767814F, 0x9E3779B97F4A7C15)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hashes ^ np.uint64(salt)) * powers(base, most)[place])])
        out.append(mix(total[w.ptr[1:]] - total[w.ptr[:-1]]).view(np.int64))
    return out[0], out[1]


def joined_sha(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _first_pass(rows: DataFrame, window: int, k: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            for w in words(text, WHITE):
                s1, s2 = sequence_hashes(w)
                place, value = anchors(w, window, k)
                ends = np.searchsorted(place, w.ptr)
                part = slice(w.first, w.first + w.n)
                sha = [joined_sha((x.as_py() or "").encode().split()) for x in text[part]]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c)[part] for c in ("doc_id", "key", "uid")), pa.array(np.diff(w.ptr), pa.int64()), pa.array(s1), pa.array(s2), pa.array(sha), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))],
                    ["doc_id", "key", "uid", "n_words", "s1", "s2", "sha", "anchors"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, key {key}, uid long, n_words long, s1 long, s2 long, sha string, anchors array<long>")


def _windows(found: DataFrame, window: int, k: int) -> DataFrame:
    """Every window around a repeated anchor: its anchor, its own hash and its place."""
    key = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.asarray(s.values).view(np.uint64)) for s in b.column("anchors")]
            for w in words(b.column("text"), WHITE):
                _, starts, least = anchor_of(w, window, k)
                edges = np.searchsorted(starts, w.ptr)
                ok = np.concatenate([_has(sets[w.first + r], least[edges[r] : edges[r + 1]]) for r in range(w.n)])
                starts, least = starts[ok], least[ok]
                row = w.row_of()[starts]
                whose = pa.array(w.first + row)
                yield pa.RecordBatch.from_arrays([b.column("key").take(whose), b.column("uid").take(whose), pa.array(least.view(np.int64)), pa.array(at(w, starts, window).view(np.int64)), pa.array((starts - w.ptr[row]).astype(np.int32))], ["key", "uid", "a", "g", "start"])

    return found.select("key", "uid", "text", "anchors").mapInArrow(run, f"key {key}, uid long, a long, g long, start int")


def _kept(found: DataFrame, window: int, text_out: bool) -> DataFrame:
    """key, uid, text, starts of repeated windows -> what is left of the text."""
    key = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, kept = [], [], []
            for text, starts in zip(b.column("text"), b.column("starts"), strict=True):
                parts = (text.as_py() or "").encode().split()
                edge = np.zeros(len(parts) + 1, np.int32)
                first = np.asarray(starts.values)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                left = list(compress(parts, stays))
                removed.append(len(parts) - len(left))
                sha.append(joined_sha(left))
                kept.append(b" ".join(left).decode() if text_out else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("uid"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["key", "uid", "n_removed", "kept_sha256", "kept_text"])

    return found.select("key", "uid", "text", "starts").mapInArrow(run, f"key {key}, uid long, n_removed long, kept_sha256 string, kept_text string")


def repeated_substrings(docs: DataFrame, window: int = WINDOW, k: int = K, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, on demand) for every row of docs (doc_id, text).

    Words are runs of other characters than space and \\x09-\\x0D. Every word in
    a window of `window` words whose sequence also starts elsewhere is removed,
    in all places. A null text has no words; texts shorter than a window lose
    nothing; repeated rows are copies of each other; null and repeated ids are
    kept apart by a hash of the text; an empty table gives an empty result;
    other columns are ignored. All places of a repeat are equal, none is kept
    (ties); texts are read whole, the longest ones piece by piece. kept_text is
    null where nothing is removed.
    """
    text = F.coalesce("text", F.lit(""))
    uid = F.xxhash64(text)
    key = F.coalesce("doc_id", uid.cast(docs.schema["doc_id"].dataType))
    rows = docs.select("doc_id", key.alias("key"), uid.alias("uid"), text.alias("text"))
    seen = cut(_first_pass(rows, window, k), "sub-seen")
    same = ["s1", "s2", "n_words"]
    classes = cut(seen.filter(F.col("n_words") >= window).groupBy(*same).agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key")), "sub-classes")
    places = seen.filter(F.col("n_words") >= window).join(classes.select(*same, "key"), [*same, "key"]).select("key", F.explode("anchors").alias("a"))
    # as a table: a join of two plain shuffles is one whose hot keys Spark can split
    twice = cut(places.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "sub-twice")
    seeds = places.join(twice, "a", "left_semi").groupBy("key").agg(F.collect_set("a").alias("anchors"))
    found = cut(rows.select("key", "uid", "text").join(seeds, "key"), "sub-found")
    spans = _windows(found, window, k)
    again = cut(spans.groupBy("a", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "g"), "sub-again")
    starts = spans.join(again, ["a", "g"], "left_semi").groupBy("key", "uid").agg(F.collect_set("start").alias("starts"))
    left = cut(_kept(found.join(starts, ["key", "uid"]), window, text_out).dropDuplicates(["key", "uid"]), "sub-left")

    out = seen.drop("anchors").join(classes.select(*same, "m"), same, "left").join(left, ["key", "uid"], "left")
    whole = F.coalesce(F.col("m") > 1, F.lit(False))
    nothing = joined_sha([])
    cols = [
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if text_out else []))


def op4_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), w as (
  select r, unnest(words) as word, unnest(range(len(words))) as i from d
), win as (
  select r, i, md5(string_agg(word, ' ') over ahead) as h, count(*) over ahead as n from w window ahead as (partition by r order by i rows between current row and {WINDOW - 1} following)
), dup as (
  select r, i from (select r, i, count(*) over (partition by h) as c from win where n = {WINDOW}) where c > 1
), gone as (
  select distinct r, i + j as i from dup, (select unnest(range({WINDOW})) as j)
), kept as (
  select w.r, string_agg(w.word, ' ' order by w.i) as text from w anti join gone using (r, i) group by w.r
), n as (
  select r, count(*)::bigint as n from gone group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join n using (r) left join kept using (r)
"""
