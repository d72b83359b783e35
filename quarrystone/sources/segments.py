"""The segment log: immutable segments, and what of them is visible."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import Variant, compile_filter

SCHEMA = "namespace string, row_seq long, op string, id string, values array<float>, metadata variant, delete_filter string"


def visible(log: DataFrame, meta: str = "metadata") -> DataFrame:
    """The rows that are left after all segments, replayed in order: the last write of an id wins.

    log: SCHEMA's columns (any payload may stand for values and metadata) and
    seg_seq. A segment's delete_all and delete_filter act on earlier segments
    only. Aggregating with max_by combines within tasks, so an id, or a
    namespace, that is written often isn't gathered in one task first.
    """
    payload = [c for c in log.columns if c not in ("namespace", "seg_seq", "row_seq", "op", "id", "delete_filter")]
    last = log.groupBy("namespace", "id").agg(F.max_by(F.struct("op", "seg_seq", *payload), F.struct("seg_seq", "row_seq")).alias("r"))
    rows = last.filter("id is not null and r.op = 'upsert'").select("namespace", "id", "r.seg_seq", *[F.col(f"r.{c}") for c in payload])
    cleared = log.filter("op = 'delete_all'").groupBy("namespace").agg(F.max("seg_seq").alias("cleared"))
    rows = rows.join(cleared, "namespace", "left").filter("cleared is null or seg_seq > cleared").drop("cleared")
    if "delete_filter" in log.columns:
        for r in log.filter("op = 'delete_filter'").select("namespace", "seg_seq", "delete_filter").distinct().collect():  # one row a request
            hit = compile_filter(json.loads(r.delete_filter), Variant(F.col(meta)))
            rows = rows.filter(~((F.col("namespace") == r.namespace) & (F.col("seg_seq") < r.seg_seq) & hit))
    return rows
