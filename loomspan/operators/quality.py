"""Run history, quality trends, caches and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import keep_first


def latest_by(rows: DataFrame, keys: list[Column], value: Column, order: Column, name: str) -> DataFrame:
    """The value of the last row of each key; at a tie of run dates the later line."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def preferred_source(rows: DataFrame, language: str, source: str, score: str, run_date: str, pos: str) -> DataFrame:
    """The source of the greatest (score, run date, position) of each language."""
    return rows.groupBy(F.lower(language).alias("language")).agg(F.max_by(source, F.struct(score, run_date, pos)).alias("preferred_source"))


def last_trend(rows: DataFrame, language: str, score: str, pos: str, band: float = 0.01) -> DataFrame:
    """(language, trend): the last two scores in file order, within a band of no change."""
    w = Window.partitionBy(F.lower(language)).orderBy(pos)
    moved = rows.select(F.lower(language).alias("language"), pos, score, F.lag(score).over(w).alias("before"), F.row_number().over(Window.partitionBy(F.lower(language)).orderBy(F.desc(pos))).alias("n"))
    delta = F.col(score) - F.col("before")
    return moved.where("n = 1").select("language", F.when(F.col("before").isNull(), "").when(delta > band, "up").when(delta < -band, "down").otherwise("flat").alias("trend"))


def last_n(rows: DataFrame, language: str, run_date: str, pos: str, n: int) -> DataFrame:
    return keep_first(rows, F.row_number().over(Window.partitionBy(language).orderBy(F.desc(run_date), F.desc(pos))), n)


def confidence(documents: Column, success: Column) -> Column:
    return F.when((documents >= 200) & (success >= 0.9), "high").when((documents >= 50) & (success >= 0.7), "medium").when(documents > 0, "low").otherwise("")


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.6, "C").otherwise("D")


def cache_decision(policy: Column, age_hours: Column, ttl_hours: Column, force: Column, present: Column, known: Column, same: Column, over_budget: Column) -> Column:
    """struct(refresh, reason) of a cache entry, the first rule that applies."""
    rule = lambda refresh, reason: F.struct(F.lit(refresh).alias("refresh"), F.lit(reason).alias("reason"))
    return (
        F.when(force, rule(True, "force_refresh"))
        .when(~present & over_budget, rule(False, "cache_budget_exceeded"))
        .when(~present, rule(True, "missing_cache"))
        .when(~known, rule(True, "missing_metadata"))
        .when(~same, rule(True, "identity_mismatch"))
        .when(policy == "always-refresh", rule(True, "always_refresh"))
        .when((policy == "ttl") & (age_hours >= ttl_hours), rule(True, "ttl_expired"))
        .when(policy == "ttl", rule(False, "ttl_fresh"))
        .when(policy == "validate-if-possible", rule(True, "validate_with_conditional"))
        .otherwise(rule(False, "use_present"))
    )


def next_refresh(fetched_at: Column, policy: Column, ttl_hours: Column) -> Column:
    return F.when(policy == "ttl", fetched_at + F.make_dt_interval(F.lit(0), F.greatest(F.lit(0), F.coalesce(ttl_hours, F.lit(24)))))


def health(age_hours: Column, failed: Column, stale_after: float = 168.0) -> Column:
    return F.when(failed, "failed").when(age_hours.isNull() | (age_hours > stale_after), "degraded").otherwise("ok")


def sparkline(rows: DataFrame, by: str, order: str, value: str, levels: str = "▁▂▃▄▅▆▇█") -> DataFrame:
    """(by, sparkline): values in order as levels between the least and the greatest of the group."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    at = F.when(high == low, F.lit(0)).otherwise(F.floor((F.col(value) - low) / (high - low) * (len(levels) - 1))).cast("int")
    marked = rows.select(by, order, F.substring(F.lit(levels), at + 1, F.lit(1)).alias("mark"))
    return marked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "mark"))), lambda x: x["mark"]), "").alias("sparkline"))
