"""Structured Streaming forms: event folds, windows with watermarks, sessions, keyed state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    import os

    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def fold_counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Counters by kind, as they stand."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def windowed(events: DataFrame, at: str, kind: str, size: str, delay: str) -> DataFrame:
    """Counts in tumbling windows; events later than the delay are left out."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, delay: str) -> DataFrame:
    """The last event of each session of a key."""
    grouped = events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).select(key, "n", "last_id")


def running_streak(events: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """(key, events, streak, failures) after each batch of a key: state kept across batches."""
    state = StructType([StructField(n, LongType()) for n in ("events", "streak", "failures")])
    out = StructType([StructField("key", LongType()), *state.fields])

    def update(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, streak, bad = held.get if held.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for failed_now in rows[failed]:
            n, bad, streak = n + 1, bad + int(failed_now), 0 if failed_now else streak + 1
        held.update((n, streak, bad))
        yield pd.DataFrame([(keys[0], n, streak, bad)], columns=["key", "events", "streak", "failures"])

    return events.groupBy(key).applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, into parquet; each batch replaces its own folder, so a batch that is run again adds nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def latest_batch(rows: DataFrame) -> DataFrame:
    """Of a stream drained in complete mode: the state after its last batch."""
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")  # one row
