"""Idempotency of a stream of change events: a key counts once within a window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from entityflow.operators.events import idempotency_key


def deduplicate_stream(events: DataFrame, *, at: str = "received_at", keep: str = "7 days") -> DataFrame:
    """First deliveries only. ``at`` is a timestamp with zone; state older than ``keep`` is dropped by the watermark."""
    return events.withColumn("key", idempotency_key()).withWatermark(at, keep).dropDuplicatesWithinWatermark(["key"])
