"""Manifests of bundles, their differences and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import keep_first


def document_hashes(docs: DataFrame, bundle: str, path: Column, text: str) -> DataFrame:
    return docs.select(bundle, path.alias("path"), F.sha2(text, 256).alias("sha256"), F.length(text).cast("bigint").alias("chars"))


def manifests(hashes: DataFrame, bundle: str) -> DataFrame:
    """(bundle, document_count, total_chars, content_sha256); the last is of the sorted path:sha lines."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "sha256"))), "\n")
    return hashes.groupBy(bundle).agg(F.count(F.lit(1)).alias("document_count"), F.sum("chars").alias("total_chars"), F.sha2(lines, 256).alias("content_sha256"))


def differences(current: DataFrame, previous: DataFrame, bundle: str) -> DataFrame:
    """(bundle, path, status) of added, removed and changed paths; a bundle without a previous manifest has none."""
    now = current.select(bundle, "path", F.col("sha256").alias("now"))
    before = previous.select(bundle, "path", F.col("sha256").alias("before"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    joined = now.join(before, [bundle, "path"], "full").withColumn("status", status).where("status is not null").select(bundle, "path", "status")
    return joined.join(previous.select(bundle).distinct(), bundle, "left_semi")


def summary(changes: DataFrame, bundle: str) -> DataFrame:
    return changes.groupBy(bundle).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")])


def newest(rows: DataFrame, by: str, order: list[Column], keep: int) -> DataFrame:
    """The ``keep`` newest rows of each group, one at least."""
    return keep_first(rows, F.row_number().over(Window.partitionBy(by).orderBy(*order)), max(1, keep))


def run_differences(runs: DataFrame, bundle: str, run: str) -> DataFrame:
    """(bundle, run, path, status) of each run against the one before; runs hold (bundle, run, path, sha256)."""
    numbered = runs.withColumn("run_no", F.dense_rank().over(Window.partitionBy(bundle).orderBy(run)))
    names = numbered.select(bundle, run, "run_no").distinct()
    now = numbered.select(bundle, "run_no", "path", F.col("sha256").alias("now"))
    before = numbered.select(bundle, (F.col("run_no") + 1).alias("run_no"), "path", F.col("sha256").alias("before"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    changes = now.join(before, [bundle, "run_no", "path"], "full").withColumn("status", status).where("status is not null and run_no > 1")
    return changes.join(names, [bundle, "run_no"]).select(bundle, run, "path", "status")
