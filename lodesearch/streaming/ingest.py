"""Streams of documents into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rows
from ..sources.store import DocumentStore


def upsert_stream(stream: DataFrame, store: DocumentStore, index: str, checkpoint: str, version: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Puts each micro-batch into an index. A batch that is repeated after a failure puts the same documents again.

    version: a column; of a batch's rows with the same id the one of the greatest version is kept. interval: a processing-time trigger;
    without one all that is available is taken and the query ends.
    """

    def put(batch: DataFrame, _: int) -> None:
        own = rows.latest(batch, [store.id_col], version) if version else batch
        store.put(index, own.where(F.col(store.id_col).isNotNull()))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def batch_size(n: int, workers: int) -> int:
    """Documents a worker takes at once: an even share, from 10 to 50."""
    return min(50, max(10, n // max(1, workers)))
