"""Continuous indexing: micro-batches merged into a store. Ids are functions of the content, so a batch that is
delivered twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def upserts(rows: DataFrame, store: Store, table: str, checkpoint: str, key: str = "id", once: bool = True, order: str | None = None) -> StreamingQuery:
    """Starts a query that upserts every micro-batch of `rows` into the table; of repeated ids in a batch the last row by
    `order` (without it, the last to arrive) stays."""

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch, key, order)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hits_per_window(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped, closed windows are emitted once."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return w.select("window.start", "window.end", by, "n")
