"""Sessions and usage totals on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ENGAGED_PING_MS, MIN_PING_MS, SESSION_GAP_MINUTES


def sessions_stream(
    stream: DataFrame,
    watermark: str,
    user: str = "user_id",
    ts: str = "ts",
    gap: str = f"{SESSION_GAP_MINUTES} minutes",
) -> DataFrame:
    """Sessions per client: ``user, events, start_us, end_us``; ``ts`` is a zoned timestamp.

    In append mode a session is emitted once the watermark has passed its end.  Events that come
    later than ``watermark`` behind the newest one are lost: choose it for the source.
    """
    windowed = stream.withWatermark(ts, watermark).groupBy(user, F.session_window(ts, gap))
    return windowed.agg(
        F.count(F.lit(1)).alias("events"),
        F.unix_micros(F.min(ts)).alias("start_us"),
        F.unix_micros(F.max(ts)).alias("end_us"),
    ).select(user, "events", "start_us", "end_us")


def engagement_stream(
    stream: DataFrame,
    watermark: str,
    user: str = "user_id",
    ts: str = "ts",
    ms: str = "engagement_ms",
    gap_minutes: int = SESSION_GAP_MINUTES,
    min_ms: int = MIN_PING_MS,
    engaged_ms: int = ENGAGED_PING_MS,
) -> DataFrame:
    """Per session: ``user, start_us, pings, engaged_ms, engaged``, as ``engagement`` on a batch.

    The flags are part of the session's state, so a session is one row once the watermark has passed its
    end. An event exactly one gap after the last one still belongs to the session, as in a batch.
    """
    gap = f"{gap_minutes} minutes 1 microseconds"
    counted = F.when(F.col(ms) >= min_ms, F.col(ms).cast("bigint"))
    windowed = stream.withWatermark(ts, watermark).groupBy(user, F.session_window(ts, gap))
    return windowed.agg(
        F.unix_micros(F.min(ts)).alias("start_us"),
        F.count(counted).alias("pings"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("engaged_ms"),
        F.coalesce(F.bool_or(counted >= engaged_ms), F.lit(False)).alias("engaged"),
    ).select(user, "start_us", "pings", "engaged_ms", "engaged")


def usage_windows(
    stream: DataFrame,
    watermark: str,
    window: str = "1 day",
    event: str = "event_type",
    ts: str = "ts",
    slide: str | None = None,
) -> DataFrame:
    """Events per event name and time window; rows later than ``watermark`` are lost."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = stream.withWatermark(ts, watermark).groupBy(span, event)
    return counted.agg(F.count(F.lit(1)).alias("events")).select(
        F.unix_micros("window.start").alias("window_start_us"), event, "events"
    )


def drain(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all input there is, append its rows to ``path`` and read them back."""
    query = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
