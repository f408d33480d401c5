"""Streams that can be killed and started again: each row is written once, progress is kept, repeats are told by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.tables import append_new, replace_partitions


def write_once(rows: DataFrame, path: str, progress: str, keys: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start a query that appends the rows of a stream to a table at `path`, each key once, and stops when it has read all there is.

    A batch that was cut short is given again after a restart from the same checkpoint: rows whose keys the
    table has are left out, so nothing is done or written twice.  `work` is applied to the rows that are
    left, and may be costly.  Of a key that a batch repeats one row is kept; rows of null keys go.  `progress` has a row (batch,
    given, written) for each batch, which a repeated batch replaces.
    """

    def put(batch: DataFrame, number: int) -> None:
        once = batch.dropna(subset=keys).dropDuplicates(keys)
        given = once.count()
        before = _count(batch, path)
        append_new(once, path, keys, work)
        told = batch.sparkSession.createDataFrame([(number, given, _count(batch, path) - before)], "batch long, given long, written long")
        replace_partitions(told, progress, "batch")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _count(batch: DataFrame, path: str) -> int:
    batch.sparkSession.catalog.refreshByPath(path)
    try:
        return batch.sparkSession.read.parquet(path).count()
    except Exception as error:  # a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0


def repeats(events: DataFrame, ts: str, key: str, late: str = "10 minutes", limit_ms: int = 3_600_000) -> DataFrame:
    """(key, first, last, n) of each key's events, once no event of it can come within `limit_ms` of its last one.

    A key whose events pause longer starts anew.  State is one row a key, and goes when its time is over; null keys
    are told together.
    """

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "first": [first], "last": [last], "n": [n]})
            return
        spans = [*([state.get] if state.exists else []), *((at, at, 1) for at in (int(t.value // 1000) for frame in frames for t in frame[ts]))]
        held: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if held and first - held[-1][1] <= limit_ms * 1000:
                held[-1] = (held[-1][0], max(held[-1][1], last), held[-1][2] + n)
            else:
                held.append((first, last, n))
        done = held[:-1]
        state.update(held[-1])
        state.setTimeoutTimestamp(max(held[-1][1] // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({key: [group[0]] * len(done), "first": [d[0] for d in done], "last": [d[1] for d in done], "n": [d[2] for d in done]})

    kind = events.schema[key].dataType.simpleString()
    marked = events.withWatermark(ts, late).select(key, ts)
    told = marked.groupBy(key).applyInPandasWithState(follow, f"`{key}` {kind}, first long, last long, n long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(key, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


def sessions(events: DataFrame, ts: str, key: str, limit_ms: int = 3_600_000) -> DataFrame:
    """The same of a whole table: (key, first, last, n) of each key's runs of events with pauses of at most `limit_ms`."""
    order = Window.partitionBy(key).orderBy("_at")
    at = events.select(key, F.unix_micros(ts).alias("_at"))
    new = at.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(order) > limit_ms * 1000).cast("int"), F.lit(0)))
    run = new.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.timestamp_micros(F.min("_at")).alias("first"), F.timestamp_micros(F.max("_at")).alias("last"), F.count("*").alias("n")).drop("_run")
