"""Structured Streaming ingest: a stream of changes is applied to the published snapshot batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.updates import updated
from ..sources import snapshots


def ingest(changes: DataFrame, root: str, checkpoint: str, normalizer=None, **trigger) -> StreamingQuery:
    """Starts a query that applies ``changes`` (seq, op, ref, fields) to the snapshot in ``root``.

    A batch is applied in the order of seq. Its number is published with the snapshot that holds it, in one step, so that a
    batch that is delivered again after a failure, whenever that was, takes effect once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                snapshots.update(batch.sparkSession, root, lambda index, docs: updated(index, docs, batch), normalizer, batch=number)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
