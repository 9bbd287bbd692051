"""Structured Streaming forms: the sliding-log limiter, windowed counts, answers out of step streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.log import LIMIT, SECONDS, reduce_trace


def limit_stream(events: DataFrame, key: str, micros: str, tie: str, limit: int = LIMIT, seconds: int = SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, tie, micros, allowed) of a stream of events (bigint columns): as ``rate_limited``, by event time within
    each micro-batch.  State per key: the live times, ``limit`` at most; it goes once the watermark, ``late`` behind the newest event,
    has passed the last of them by ``seconds``, however fast or slow the stream is read.  Events later than ``late``, or not after the epoch, are dropped."""
    import pandas as pd

    span = seconds * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([micros, tie])
        allowed = []
        for t in rows[micros]:
            live = [x for x in live if t - x < span]
            allowed.append(len(live) < limit)
            if allowed[-1]:
                live.append(int(t))
        state.update((live,))
        state.setTimeoutTimestamp(max((live[-1] + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: rows[key], tie: rows[tie], micros: rows[micros], "allowed": allowed})

    schema = f"{key} long, {tie} long, {micros} long, allowed boolean"
    timed = events.select(key, tie, micros, F.timestamp_micros(micros).alias("_at")).withWatermark("_at", late)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "live array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts per window of ``width`` and keys; ``late``: the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, ts: str, width: str, slide: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, gap: str | Column, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def answers(steps: DataFrame, key: str = "request", cached: DataFrame | None = None) -> DataFrame:
    """Per request of a step stream (complete mode): the last answer, the cached image or else the first one, the tools in order."""
    return reduce_trace(steps, key, cached)


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """The stream appended to a Parquet table, each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
