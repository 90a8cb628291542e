"""The sync engine and the breaker over streams: each micro-batch is one batch of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entityflow.operators.sync import MAX_CHANGES, SyncEngine


def run_stream(events: DataFrame, engine: SyncEngine, checkpoint: str) -> StreamingQuery:
    """Ingest and push every micro-batch; its time is that of its newest event, so that a replay writes the same.

    A batch that runs again after a failure finds its observations stored already: they repeat the newest and are
    duplicates, and its writes change nothing any more.
    """

    def batch(rows: DataFrame, _: int) -> None:
        now = rows.agg(F.max("received_us")).first()[0]
        if now is not None:
            engine.run_cycle(rows, now)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loops(events: DataFrame, *, at: str = "received_at", window: str = "5 minutes", slide: str = "1 minute", limit: int = MAX_CHANGES) -> DataFrame:
    """(source, record_id, window, changes) of records with more than ``limit`` changes in a sliding window of event time."""
    seen = events.withWatermark(at, window).groupBy(F.window(at, window, slide), "source", "record_id")
    return seen.agg(F.count(F.lit(1)).alias("changes")).filter(F.col("changes") > limit)
