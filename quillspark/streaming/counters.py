"""Daily counters and arrival dedup on streams; on the same rows they agree with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str, by: str, late: str | None = "2 days") -> DataFrame:
    """Counts per UTC day and group; a day closes once the watermark passes it.  `late` None keeps the watermark that events have."""
    marked = events.withWatermark(ts, late) if late else events
    return marked.groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def first_arrivals(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: an idempotent sink's input."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
