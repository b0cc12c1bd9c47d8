"""Usage events: sessions, engagement and totals on batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ENGAGED_PING_MS, MIN_PING_MS, SESSION_GAP_MINUTES


def only_consented(events: DataFrame, consents: DataFrame, user: str) -> DataFrame:
    """Events of clients that gave consent; works with a streaming left side too."""
    return events.join(consents.select(user), user, "left_semi")


def usage(df: DataFrame, event: str = "event_type", user: str = "user_id") -> DataFrame:
    """Events and exact unique clients per event name."""
    per_pair = df.groupBy(event, user).agg(F.count(F.lit(1)).alias("n"))
    return per_pair.groupBy(event).agg(
        F.sum("n").alias("events"), F.count(user).alias("unique_clients")
    )


def _spans(df: DataFrame, user: str, ts: str, gap_minutes: float) -> tuple[DataFrame, Column]:
    """Events tagged with a time bucket one gap wide.

    Two events of a client in one bucket are less than a gap apart, so a bucket never
    straddles two sessions.  That makes buckets the unit of work: they are counted on the map
    side, and only bucket rows, at most one per client and gap of time, are ever ordered.
    """
    width = int(gap_minutes * 60_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumns({"_at": micros, "_bucket": micros - F.pmod(micros, F.lit(width))}), F.lit(width)


def _numbered_buckets(buckets: DataFrame, user: str, width: Column) -> DataFrame:
    by_time = Window.partitionBy(user).orderBy("_bucket")
    previous = F.lag("_last").over(by_time)
    opens = F.when(previous.isNull() | (F.col("_first") - previous > width), 1).otherwise(0)
    marked = buckets.withColumn("_opens", opens)
    return marked.withColumn("session_no", F.sum("_opens").over(by_time).cast("bigint"))


def sessions(
    df: DataFrame, user: str = "user_id", ts: str = "ts", gap_minutes: float = SESSION_GAP_MINUTES
) -> DataFrame:
    """``(user, session_no, events, start_us, end_us)``: one row per session.

    A new session starts after more than ``gap_minutes`` without an event; exactly that long
    still belongs to the old one.  Times are microseconds since 1970.  Events without a time
    belong to no session; events without a client count as one client.
    """
    timed = df.select(user, ts).filter(F.col(ts).isNotNull())
    tagged, width = _spans(timed, user, ts, gap_minutes)
    buckets = tagged.groupBy(user, "_bucket").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_events")
    )
    return _numbered_buckets(buckets, user, width).groupBy(user, "session_no").agg(
        F.sum("_events").alias("events"), F.min("_first").alias("start_us"), F.max("_last").alias("end_us")
    )


def sessionize(
    df: DataFrame, user: str = "user_id", ts: str = "ts", gap_minutes: float = SESSION_GAP_MINUTES
) -> DataFrame:
    """Every event that has a time, with the number of its session within the client.

    Events without a client count as one client, as in ``sessions``.
    """
    tagged, width = _spans(df.filter(F.col(ts).isNotNull()), user, ts, gap_minutes)
    buckets = tagged.groupBy(user, "_bucket").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    numbers = _numbered_buckets(buckets, user, width).select(
        F.col(user).alias("_user"), F.col("_bucket").alias("_of"), "session_no"
    )
    same = F.col(user).eqNullSafe(F.col("_user")) & (F.col("_bucket") == F.col("_of"))
    return tagged.join(numbers, same).drop("_at", "_bucket", "_user", "_of")


def engagement(
    df: DataFrame,
    user: str = "user_id",
    session: str = "session_no",
    ms: str = "engagement_ms",
    min_ms: int = MIN_PING_MS,
    engaged_ms: int = ENGAGED_PING_MS,
) -> DataFrame:
    """Per session: pings kept, engaged time and whether one ping was long enough.

    Pings below ``min_ms`` do not count; a session that has only such pings stays, not engaged.
    """
    counted = F.when(F.col(ms) >= min_ms, F.col(ms).cast("bigint"))
    return df.groupBy(user, session).agg(
        F.count(counted).alias("pings"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("engaged_ms"),
        F.coalesce(F.bool_or(counted >= engaged_ms), F.lit(False)).alias("engaged"),
    )
