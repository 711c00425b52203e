"""Shared storage for cut lineage and for files that tasks exchange."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where the session has none (tests)."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, free: bool = False, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and losing executors loses nothing.

    With free, the shuffle files of the writing go when it ends, not when the driver happens to collect garbage.
    With batch, Python functions are sent so many rows at once at most.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    settings = {_FREE: "true"} if free else {}
    if batch:
        settings[_BATCH] = str(batch)
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return to the system what this process has freed: Arrow and the C library keep it else, as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean_stream(task: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What task makes of batches; the worker gives back memory before, left by other stages, and after."""
    give_back()
    yield from task(batches)
    give_back()


def lean_group(task: Callable, group: pa.Table) -> pa.Table:
    """What task makes of a group; the worker gives back memory after."""
    made = task(group)
    give_back()
    return made


def local_path(uri: str) -> str:
    """The file-system path of a shared location (mounted storage)."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri} is not mounted storage; mount the shared folder or set {_SETTING} to a mounted path")
    return parsed.path


def partitions(spark: SparkSession) -> int:
    """Buckets for a two-level computation: as many as the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Characters whose hashes one slice of a hash range takes: about 3 million hashes, or 200 MB with what is made of them.
SLICE_CHARACTERS = 16_000_000


def slices_for(rows: DataFrame, column: str) -> int:
    """Slices of a hash range that hold a bounded number of the words of all texts each, one for each shuffle partition at least."""
    characters = rows.agg(F.sum(F.length(column))).first()[0] or 0
    return max(partitions(rows.sparkSession), -(-characters // SLICE_CHARACTERS))


def integral(df: DataFrame, name: str) -> Column:
    """A column of whole numbers as bigint."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} is {kind}; an integral type is needed")
    return df[name].cast("bigint")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
