"""Streaming writes: micro-batches become segments, each published once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def stream_into(store: Store, name: str, rows: DataFrame, checkpoint: str, namespace: str = "default", trigger: dict | None = None) -> StreamingQuery:
    """rows: a stream of row_seq, op ('upsert' or 'delete'), id, values, metadata (VARIANT).

    A batch's id is its operation: a batch that is replayed after a crash finds
    itself applied in the manifest and is skipped, so delivery at least once
    ends in effects exactly once. Within a batch the later row wins by row_seq.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        log = batch.select("row_seq", "op", "id", "values", "metadata", F.lit(None).cast("string").alias("delete_filter"))
        store.append(name, log, namespace, operation=f"stream:{checkpoint}:{batch_id}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
