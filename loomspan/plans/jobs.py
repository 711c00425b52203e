"""Event log queries: conversations are jobs (turn is the index), events are requests by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..registry import register
from ..sources.tables import table


@register(
    "job_progress_fold",
    """SELECT conv_id, count(*) AS events, count(*) FILTER (role = 'assistant') AS documents, count(*) FILTER (role = 'system') AS failures, max_by(text, turn) AS last_message,
      round(count(*) FILTER (role = 'assistant') * 100.0 / count(*), 2) AS percent FROM conversations GROUP BY conv_id""",
)
def job_progress_fold(spark, sf_dir):
    return J.progress(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "assistant", "system")


@register("event_replay_from", "SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 2")
def event_replay_from(spark, sf_dir):
    log = table(spark, sf_dir, "conversations")
    return J.replay(log.unionByName(log.where("turn % 2 = 0")), "conv_id", "turn", 2).select("conv_id", "turn")


@register("job_recents", "SELECT * FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY user_id, event_type) WHERE place <= 3")
def job_recents(spark, sf_dir):
    return J.recents(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3)


@register("job_queue_positions", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events WHERE event_type = 'view'")
def job_queue_positions(spark, sf_dir):
    return J.queue_positions(table(spark, sf_dir, "events").where("event_type = 'view'"), "user_id", "event_id").select("event_id", "position")


@register(
    "breaker_sliding_failures",
    """SELECT event_id, failures, failures >= 3 AS open FROM (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 720 MINUTES PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM events)""",
)
def breaker_sliding_failures(spark, sf_dir):
    return J.trailing_failures(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", 720).select("event_id", "failures", "open")


@register("breaker_states")
def breaker_states(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("failed"))
    return J.breaker_states(events, "user_id", "us", "event_id", "failed", 2, 86_400.0, 43_200.0)


@register("concurrency_controller")
def concurrency_controller(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("failures"), F.lit(0).alias("retries"), (F.col("value") > 1e9).alias("memory")
    )
    return J.concurrency(reports, "user_id", "event_id")


@register(
    "debounce_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, count(*) AS n, max(event_id) FILTER (TRUE) AS last_id FROM s GROUP BY user_id, session""",
)
def debounce_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).select("user_id", "n", "last_id")


@register("retry_delays", "SELECT event_id, least(5.0, 0.5 * pow(2, event_id % 6)) AS delay FROM events")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.retry_delay(F.col("event_id") % 6 + 1).alias("delay"))


@register("request_spacing", "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 AS too_soon FROM events")
def request_spacing(spark, sf_dir):
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", (us - before < 3_600_000_000).alias("too_soon"))
