"""Streaming queries: the events table drained as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import register
from ..storage import scratch
from ..streaming import operators as S


def _folder(spark) -> str:
    """A new folder for sinks and checkpoints: shared storage where the session names one."""
    return scratch(spark, "stream")


@register("stream_event_fold", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_event_fold(spark, sf_dir):
    at = _folder(spark)
    return S.latest_batch(S.drain(S.fold_counts(S.event_stream(spark, sf_dir)), f"{at}/out", f"{at}/state", "complete"))


@register("stream_windows")
def stream_windows(spark, sf_dir):
    """Closed windows only: the last ones stay open behind the watermark."""
    at = _folder(spark)
    counts = S.windowed(S.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour")
    return S.drain(counts, f"{at}/out", f"{at}/state").drop("batch")


@register("stream_sessions")
def stream_sessions(spark, sf_dir):
    at = _folder(spark)
    rows = S.sessions(S.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours", "1 hour")
    return S.drain(rows, f"{at}/out", f"{at}/state").drop("batch")


@register(
    "stream_streaks",
    """WITH e AS (SELECT user_id AS key, event_id, event_type = 'error' AS failed FROM events), l AS (SELECT key, max(event_id) FILTER (failed) AS last_failure FROM e GROUP BY key)
    SELECT key, count(*) AS events, count(*) FILTER (last_failure IS NULL OR event_id > last_failure) AS streak, count(*) FILTER (failed) AS failures FROM e JOIN l USING (key) GROUP BY key""",
)
def stream_streaks(spark, sf_dir):
    at = _folder(spark)
    events = S.event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "error").alias("failed"))
    rows = S.drain(S.running_streak(events, "key", "event_id", "failed"), f"{at}/out", f"{at}/state", "update")
    return rows.groupBy("key").agg(*[F.max_by(c, "batch").alias(c) for c in ("events", "streak", "failures")])
