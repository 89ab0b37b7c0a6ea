"""Streams: bursts of events as sessions, and an index that follows changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(events: DataFrame, key: str, time: str, gap: str = "8 seconds", late: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events less than a gap apart; late events are waited for so long."""
    rows = events.withWatermark(time, late) if late else events
    window = F.session_window(time, gap)
    return rows.groupBy(key, window.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def follow(files: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs apply on each batch of new files; a batch that is repeated after a failure has the same number."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
