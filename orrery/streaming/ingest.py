"""Continuous ingest: micro-batches of points into a collection, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.sources.store import Store


def ingest(points: DataFrame, store: Store, collection: str, checkpoint: str, seal_rows: int | None = None) -> StreamingQuery:
    """Each micro-batch is appended; points are visible when their batch is published.

    A batch that is tried again after a failure writes no point twice, as names that exist are left out.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.append(collection, batch)
        if seal_rows is not None:
            buffered = sum(s["rows"] for s in store.manifest(collection)["segments"] if not s["sealed"])
            if buffered >= seal_rows:
                store.seal(collection)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window; later rows than `late` are left out in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
