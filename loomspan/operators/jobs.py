"""Ordered event logs: progress folds, replay, queues, recents, breakers and the concurrency controller."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progress(events: DataFrame, job: str, idx: str, kind: str, message: str, document: str = "document", failure: str = "failure") -> DataFrame:
    """(job, events, documents, failures, last_message, percent): the fold of a job's events; document and failure are the kinds that count as such."""
    documents, failures = F.count_if(F.col(kind) == document), F.count_if(F.col(kind) == failure)
    return events.groupBy(job).agg(
        F.count(F.lit(1)).alias("events"), documents.alias("documents"), failures.alias("failures"), F.max_by(message, idx).alias("last_message"),
        F.round(documents * 100.0 / F.count(F.lit(1)), 2).alias("percent"),
    )


def replay(events: DataFrame, job: str, idx: str, start: int) -> DataFrame:
    """Events from an index on, each position once."""
    return events.where(F.col(idx) >= start).dropDuplicates([job, idx])


def recents(touches: DataFrame, by: str, item: str, at: str, keep: int = 30) -> DataFrame:
    """(by, item, place): items by last touch, newest first."""
    last = touches.groupBy(by, item).agg(F.max(at).alias("at"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), item)).cast("bigint")
    return last.withColumn("place", place).where(F.col("place") <= keep).select(by, item, "place")


def queue_positions(jobs: DataFrame, queue: str, seq: str) -> DataFrame:
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy(queue).orderBy(seq)).cast("bigint"))


def trailing_failures(events: DataFrame, host: str, at: str, failed, minutes: int = 60, threshold: int = 3) -> DataFrame:
    """Events with failures of the host in the trailing window and whether that many open the breaker."""
    frame = Window.partitionBy(host).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn("failures", F.sum(failed.cast("bigint")).over(frame)).withColumn("open", F.col("failures") >= threshold)


def breaker_states(events: DataFrame, host: str, at: str, order: str, failed: str, threshold: int = 3, window_s: float = 60.0, open_s: float = 60.0) -> DataFrame:
    """(host, order, state) before each event: closed, open, or half_open when one probe may pass; a probe's outcome decides.

    ``at`` is a timestamp or date, or a whole number of microseconds.
    """
    kind = dict(events.dtypes)[at]
    micros = F.col(at).cast("bigint") if kind in ("bigint", "int") else F.unix_micros(F.col(at).cast("timestamp"))
    schema = ", ".join(f"{c} {t}" for c, t in events.select(host, order).dtypes) + ", state string"
    events = events.select(host, order, micros.alias("micros"), F.col(failed).cast("boolean").alias("bad"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["micros", order])
        failures: list[float] = []
        opened: float | None = None
        states = []
        for now, bad in zip(pdf["micros"] / 1e6, pdf["bad"], strict=True):
            state = "closed" if opened is None else "half_open" if now - opened >= open_s else "open"
            states.append(state)
            if state == "open":
                continue
            if not bad:
                opened, failures = (None, []) if state == "half_open" else (opened, failures)
                continue
            failures = [t for t in failures if now - t <= window_s] + [now]
            if state == "half_open" or len(failures) >= threshold:
                opened = now
        return pdf.assign(state=states)[[host, order, "state"]]

    return events.groupBy(host).applyInPandas(fold, schema)


def concurrency_trace(reports: list[dict], start: int, least: int, most: int) -> list[int]:
    """Levels after each report: up after two good ones in a row, down under pressure, 1 under memory pressure."""
    level, streak, out = max(least, min(most, start)), 0, []
    for r in reports:
        if r.get("memory"):
            level, streak = 1, 0
        elif r.get("failures") or r.get("retries", 0) >= 3:
            level, streak = max(least, level - 1), 0
        else:
            streak += 1
            if streak == 2:
                level, streak = min(most, level + 1), 0
        out.append(level)
    return out


def concurrency(events: DataFrame, by: str, order: str, start: int = 2, least: int = 1, most: int = 6) -> DataFrame:
    """(by, order, level) of the controller over reports (failures, retries, memory)."""
    schema = ", ".join(f"{c} {t}" for c, t in events.select(by, order).dtypes) + ", level int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[[by, order]].assign(level=concurrency_trace(pdf[["failures", "retries", "memory"]].to_dict("records"), start, least, most))

    return events.groupBy(by).applyInPandas(fold, schema)


def retry_delay(attempt, base: float = 0.5, cap: float = 5.0):
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
