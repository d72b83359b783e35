"""Sharding by balanced label propagation.

Units (here: bundles of equal texts) start with pseudo-random labels. In each
round a join hands every unit the labels of the units that share a hub with
it; it asks to move to the label with most weight among them. Requests are
granted up to each shard's quota of rows, so edges between copies stop being
cut while the shards stay even. Rows without links, and what is left over,
fill the shards exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import cut, gapless, table, text_key

BUCKETS = 256
#: A text's copies start in at most so many bundles, dealt to the shards by their room.
SPOTS = 64


def quotas(total: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart."""
    return np.array([total // shards + (t < total % shards) for t in range(shards)], np.int64)


def granted(requests: np.ndarray, load: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """requests[from, to, bucket]: weight that asks to move. Returns for each target how many buckets may move.

    Starts from all and takes back one bucket at a time from shards that would overflow.
    """
    shards, buckets = len(cap), requests.shape[2]
    cuts = np.full(shards, buckets)
    sums = np.concatenate([np.zeros((shards, shards, 1), np.int64), np.cumsum(requests, 2)], 2)
    while True:
        flow = sums[:, np.arange(shards), cuts]
        after = load - flow.sum(1) + flow.sum(0)
        over = [t for t in range(shards) if after[t] > cap[t] and flow[:, t].sum()]
        if not over:
            return cuts
        t = max(over, key=lambda t: after[t] - cap[t])
        cuts[t] -= 1


def propagate(spark: SparkSession, units: DataFrame, links: DataFrame, cap: np.ndarray, rounds: int = 4) -> DataFrame:
    """Move units between shards.

    units: unit, weight, label; links: unit, hub (units are neighbours if they
    share a hub). cap: most weight of each shard. Returns unit, weight, label.
    Labels of a shard that starts above its cap may stay above it.
    """
    shards = len(cap)
    bucket = F.pmod(F.xxhash64("unit", F.lit("bucket")), F.lit(BUCKETS)).cast("int").alias("bucket")
    for _ in range(rounds):
        votes = links.join(units, "unit").groupBy("hub", "label").agg(F.sum("weight").alias("votes"))
        wanted = links.join(votes, "hub").groupBy("unit", "label").agg(F.sum("votes").alias("votes"), F.min(F.xxhash64("hub")).alias("tie"))
        wanted = wanted.groupBy("unit").agg(F.max_by("label", F.struct("votes", F.xxhash64("tie", "label"))).alias("want"))
        now = cut(units.join(wanted, "unit", "left").select("unit", "weight", "label", F.coalesce("want", "label").alias("want"), bucket), "labels")
        flows = now.groupBy("label", "want", "bucket").agg(F.sum("weight").alias("w")).collect()  # shards**2 * BUCKETS rows at most
        load, requests = np.zeros(shards, np.int64), np.zeros((shards, shards, BUCKETS), np.int64)
        for r in flows:
            load[r.label] += r.w
            if r.label != r.want:
                requests[r.label, r.want, r.bucket] += r.w
        if not requests.any():
            return units
        cuts = granted(requests, load, cap)
        limit = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("want") + 1)
        units = now.select("unit", "weight", F.when(F.col("bucket") < limit, F.col("want")).otherwise(F.col("label")).alias("label"))
        if not cuts.any():
            break
    return units


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, rounds: int = 4) -> DataFrame:
    """Deal all rows of docs (doc_id, text) out to shards, equal texts together as far as quotas allow.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard
    (null: this law says nothing about one more shard). Counts of the shards
    are at most one apart. A null text counts as an empty one; repeated rows
    and null ids are dealt like any others; other columns are ignored; an
    empty table gives an empty result. A group of copies that is larger than
    a ten-thousandth of all rows (at most 10,000 such groups exist) is placed
    first, split over as few shards as can hold it. Rows with equal hashes of
    id and text (ties) get slots in any order; a text's length doesn't matter.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text).cast("long") + 1).alias("size")
    spot = F.pmod(F.xxhash64("doc_id", F.lit("spot")), F.lit(SPOTS)).cast("int").alias("spot")
    base = cut(docs.select("doc_id", size, F.crc32(text).cast("long").alias("text_crc32"), *text_key(), spot), "shard-base")
    total = base.count()
    cap = quotas(total, shards)

    bundles = base.groupBy("g1", "g2", "spot").agg(F.count(F.lit(1)).alias("weight"))
    groups = bundles.groupBy("g1", "g2").agg(F.sum("weight").alias("n"), F.collect_list(F.struct("spot", "weight")).alias("parts")).filter("n > 1")
    groups = cut(groups, "shard-groups")
    large = max(1000, total // 10_000)
    hot = groups.filter(F.col("n") > large).select("g1", "g2", "n").orderBy(F.desc("n"), "g1", "g2").collect()  # 10,000 rows at most

    free, pieces = cap.copy(), []  # pieces: pool, first rank, rank after the last, shard
    for pool, g in enumerate(hot):
        at = 0
        while at < g.n:
            t = int(np.argmax(free))
            take = int(min(g.n - at, free[t]))
            pieces.append((pool, at, at + take, t))
            free[t] -= take
            at += take

    cold = groups.filter(F.col("n") <= large).select("g1", "g2", F.inline("parts"))
    room = np.cumsum(free) / max(1, free.sum())
    first = F.element_at(F.array(*[F.lit(int(min(shards - 1, np.searchsorted(room, (i + 0.5) / SPOTS)))) for i in range(SPOTS)]), F.col("spot") + 1)
    unit = F.struct("g1", "g2", "spot").alias("unit")
    units = propagate(spark, cold.select(unit, "weight", first.alias("label")), cold.select(unit, F.struct("g1", "g2").alias("hub")), free, rounds)

    # shards that chance left above their quota give bundles back, some bucket at a time
    bucket = F.pmod(F.xxhash64("unit", F.lit("release")), F.lit(1024)).cast("int")
    units = cut(units.withColumn("bucket", bucket), "shard-units")
    load = np.zeros((shards, 1024), np.int64)
    for r in units.groupBy("label", "bucket").agg(F.sum("weight").alias("w")).collect():
        load[r.label, r.bucket] = r.w
    sums = np.cumsum(load, 1)
    keep = [int(np.searchsorted(sums[t], free[t], "right")) for t in range(shards)]
    free -= np.array([sums[t, k - 1] if k else 0 for t, k in enumerate(keep)])
    kept = units.filter(F.col("bucket") < F.element_at(F.array(*[F.lit(k) for k in keep]), F.col("label") + 1))
    kept = kept.select(F.col("unit.g1").alias("g1"), F.col("unit.g2").alias("g2"), F.col("unit.spot").alias("spot"), F.col("label").alias("shard"))

    at = 0
    for t in range(shards):
        pieces.append((-1, at, at + int(free[t]), t))
        at += int(free[t])

    hot_rows = spark.createDataFrame([(g.g1, g.g2, i) for i, g in enumerate(hot)], "g1 long, g2 long, pool int")
    marked = base.join(F.broadcast(hot_rows), ["g1", "g2"], "left")
    linked = marked.filter("pool is null").join(kept, ["g1", "g2", "spot"], "left")
    out = [*base.columns, "pool", "shard"]
    placed = cut(linked.withColumn("pool", F.lit(-1)).select(*out).unionByName(marked.filter("pool is not null").withColumn("shard", F.lit(None).cast("int")).select(*out)), "shard-placed")
    order = ["doc_id", "g1", "g2"]
    ranked = gapless(placed.filter("shard is null"), ["pool"], order, "rank", total)
    ranges = spark.createDataFrame(pieces, "p int, a long, b long, s int")
    filled = ranked.join(F.broadcast(ranges), (F.col("pool") == F.col("p")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    cols = ["doc_id", "size", "text_crc32", "g1", "g2"]
    dealt = cut(placed.filter("shard is not null").select(*cols, "shard").unionByName(filled.select(*cols, F.col("s").alias("shard"))), "shard-dealt")
    done = gapless(dealt, ["shard"], order, "slot", total)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))
