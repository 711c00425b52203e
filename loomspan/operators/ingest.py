"""Filters, first-wins dedup and diagnostics of document scans.

A row that is left out is labelled, never lost: ``skip_reason`` is null for rows that are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import keep_first, unused


def topic_filter(values: list[str]) -> list[str]:
    """Trimmed, lower-cased, without blanks and repeats."""
    return list(dict.fromkeys(v.strip().lower() for v in values if v.strip()))


def mode_allows(topic: Column, mode: str, core: list[str], always: bool = False) -> Column:
    """Important mode keeps core topics only; an empty core keeps all unless ``always`` filters."""
    wanted = topic_filter(core)
    if mode == "full" or (not wanted and not always):
        return F.lit(True)
    return F.lower(topic).isin(wanted)


def any_topic_allowed(topics: Column, mode: str, core: list[str]) -> Column:
    """For rows of several page types: kept if any is a core one."""
    if mode == "full" or not core:
        return F.lit(True)
    return F.arrays_overlap(F.transform(topics, F.lower), F.array(*[F.lit(c) for c in topic_filter(core)]))


def topic_reason(topic: Column, include: list[str], exclude: list[str]) -> Column:
    """Reason of the topic filters; include is looked at first."""
    reason = F.lit(None).cast("string")
    if exclude:
        reason = F.when(F.lower(F.trim(topic)).isin(topic_filter(exclude)), F.lit("filtered_topic_exclude")).otherwise(reason)
    if include:
        reason = F.when(~F.lower(F.trim(topic)).isin(topic_filter(include)), F.lit("filtered_topic_include")).otherwise(reason)
    return reason


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in source order."""
    return keep_first(rows, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def scan_reasons(
    entries: DataFrame, *, key: str, order: str, topic: str, content: str, mode: str = "full", core: list[str] = (), boundary: int | None = None
) -> DataFrame:
    """Entries with ``skip_reason`` of a catalog scan.

    The order matters: rows up to a resume boundary are skipped but claim their key; then the mode filter,
    whose rows claim none; then first-wins dedup, where a row without content does claim its key; then content.
    """
    resumed = F.col(order) <= F.lit(boundary) if boundary is not None else F.lit(False)
    missing = F.col(key).isNull() | (F.col(key) == "") | F.col(topic).isNull() | (F.col(topic) == "")
    allowed = mode_allows(F.col(topic), mode, list(core))
    claims = F.when(~missing & (resumed | allowed), F.lit(1))
    place = unused(entries, "place")
    staged = entries.withColumn(place, F.sum(claims).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    reason = (
        F.when(missing, "missing_path_or_type").when(resumed, "resumed").when(~allowed, "filtered_mode")
        .when(F.col(place) > 1, "duplicate_path").when(F.col(content).isNull(), "missing_content").when(F.trim(content) == "", "empty_markdown")
    )
    return staged.withColumn("skip_reason", reason).drop(place)


def skip_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("skipped"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole within [0, 1], 4 decimals; 0 where there is no whole."""
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole)), 4))


def diagnostics(rows: DataFrame, *by: str) -> DataFrame:
    """(discovered, emitted, skipped, success_rate, skip_rate) of labelled rows."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("skip_reason").isNull()).alias("emitted"), F.count("skip_reason").alias("skipped"))
    return counts.withColumn("success_rate", rate(F.col("emitted"), F.col("discovered"))).withColumn("skip_rate", rate(F.col("skipped"), F.col("discovered")))


def fragment_references(entries: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """(doc_key, references): names and fragments that share a page, in order of first appearance."""
    parts = entries.where(F.instr(path, "#") > 0).select(
        F.split_part(F.col(path), F.lit("#"), F.lit(1)).alias("doc_key"), F.col(name).alias("name"), F.regexp_extract(F.col(path), "#(.*)$", 1).alias("fragment"), "pos"
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name", "fragment")))
    notes = F.array_distinct(F.transform(ordered, lambda r: F.concat(F.lit("- "), r["name"], F.lit(": #"), r["fragment"])))
    return parts.groupBy("doc_key").agg(notes.alias("references"))


def append_references(markdown: Column, references: Column) -> Column:
    note = F.concat(F.lit("\n\n## Merged Upstream Fragment References\n\n"), F.array_join(references, "\n"))
    return F.concat(markdown, F.when(F.size(references) > 0, note).otherwise(F.lit("")))


def verified_prefix(rows: DataFrame, group: str, order: str, bad: Column) -> DataFrame:
    """Rows before the first bad one of their group."""
    seen = F.max(bad.cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_bad", seen).where("_bad = 0").drop("_bad")


def fold_events(events: DataFrame) -> DataFrame:
    """One row of counters from adapter events (event_type, reason, count, discovered, emitted, code, message, source_url)."""
    return events.agg(
        F.sum("discovered").alias("discovered"),
        F.sum("emitted").alias("emitted"),
        F.count_if(F.col("event_type") == "document").alias("documents"),
        F.sum(F.when(F.col("event_type") == "skipped", F.coalesce("count", F.lit(1)))).alias("skipped"),
        F.sort_array(F.collect_list(F.when(F.col("event_type") == "warning", F.concat("code", F.lit(": "), "message", F.when(F.col("source_url") != "", F.concat(F.lit(" ("), "source_url", F.lit(")"))).otherwise(F.lit("")))))).alias("warnings"),
    )
