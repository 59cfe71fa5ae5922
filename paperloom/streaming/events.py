"""Event logs as streams: windowed counts with a watermark, and silences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 8) -> DataFrame:
    """New JSONL files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Events and their value per window and kind; rows later than ``lateness`` are dropped. Batch and stream alike."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    grouped = rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), kind, "n_events", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Runs of events of a key with less than ``gap`` between them."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def silences(events: DataFrame, key: str, at: str, seconds: float, lateness: str) -> DataFrame:
    """(key, last_at, next_at): silences of at least ``seconds``, with the last event of each key as state.

    A silence that an event ends has that event as ``next_at``.  One that lasts until the
    watermark has passed it is told once, with a null ``next_at``, and the key is forgotten.
    """
    micros = int(seconds * 1e6)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: group[0], "last_at": [last], "next_at": pd.to_datetime([None])})
            return
        times = pd.concat([b[at] for b in batches]).sort_values(ignore_index=True)
        before = times.shift(1)
        if last is not None and len(times):
            before.iloc[0] = last
        quiet = (times - before).dt.total_seconds() >= seconds
        newest = times.iloc[-1] if last is None else max(last, times.iloc[-1])
        state.update((int(newest.value // 1000),))
        due = int(newest.value // 1000) + micros
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], "last_at": before[quiet], "next_at": times[quiet]})

    rows = events.withWatermark(at, lateness).select(key, at)
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_at timestamp, next_at timestamp", "last bigint", "append", "EventTimeTimeout")


def heartbeats(lines: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """``lines`` with ``beat``: whether a line is told, being the first of its key or ``seconds`` after the last told one.

    What is told depends on what was told before, so each key's lines are scanned in
    order; the scan holds one number, whatever the number of lines.
    """
    schema = lines.withColumn("beat", F.lit(True)).schema

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, told = None, None
        for batch in batches:
            beats = []
            for k, t in zip(batch[key], batch[at], strict=True):
                first = owner is None or k != owner[0]
                beat = first or (t - told).total_seconds() >= seconds
                if beat:
                    owner, told = (k,), t
                beats.append(beat)
            yield batch.assign(beat=beats)

    return lines.repartition(key).sortWithinPartitions(key, at).mapInPandas(scan, schema)


def progress(query) -> dict:
    """Latest figures of a running stream: rows in, rows a second, watermark; empty before its first batch."""
    last = query.lastProgress
    if not last:
        return {}
    return {"batch": last["batchId"], "rows": last["numInputRows"], "rows_per_second": last.get("processedRowsPerSecond"), "watermark": (last.get("eventTime") or {}).get("watermark")}
