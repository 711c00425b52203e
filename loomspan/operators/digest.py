"""Length and SHA-256 of a text that is joined from many rows, without the text ever being in one place.

The rows are sorted by range into slices of a bounded size; a task takes one slice of one text and hands the hash on as it stands,
so that the next slice goes on with it.  No task reads more than a slice, however long a text is.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch, session_settings

#: Bytes of text in a slice, about; what a task reads and holds.
SLICE_BYTES = 64 << 20
#: Slices that are told to every task of a step; beyond it they are joined by a shuffle.
BROADCAST_SLICES = 100_000
_STATE = 112  # SHA256_CTX: eight words, two of length, a block, two counts


@cache
def _library() -> ctypes.CDLL | None:
    """The C library whose hash can be set aside and taken up again; hashlib's cannot."""
    try:
        found = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
        found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
        made, state = ctypes.create_string_buffer(32), ctypes.create_string_buffer(_STATE)
        found.SHA256_Init(state)
        found.SHA256_Update(state, b"abc", 3)
        found.SHA256_Final(made, state)
        return found if made.raw == hashlib.sha256(b"abc").digest() else None
    except (OSError, AttributeError):
        return None


class _Resumable:
    """A SHA-256 whose state is bytes."""

    def __init__(self, state: bytes | None = None):
        self.state = ctypes.create_string_buffer(state or b"", _STATE)
        if state is None:
            _library().SHA256_Init(self.state)

    def update(self, data: pa.Buffer) -> None:
        _library().SHA256_Update(self.state, data.address, data.size)

    def hexdigest(self) -> str:
        made, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state.raw, _STATE)
        _library().SHA256_Final(made, copy)
        return made.raw.hex()


def _bytes(column: pa.Array) -> pa.Buffer:
    """The texts of a column without nulls, one behind the other."""
    large = column.cast(pa.large_string())
    ends = memoryview(large.buffers()[1]).cast("q")
    first, last = ends[large.offset], ends[large.offset + len(large)]
    return large.buffers()[2].slice(first, last - first) if last > first else pa.py_buffer(b"")


def _hash(sha, chunks: list[pa.Array], skipped: int, opening: str | None) -> int:
    """Characters of the chunks, hashed; of the first text the separator is left out where a text begins (opening is given)."""
    n = 0
    if opening is not None:
        sha.update(pa.py_buffer(opening.encode()))
        n = len(opening)
    for chunk in chunks:
        data = _bytes(chunk)
        n += pc.sum(pc.utf8_length(chunk)).as_py() or 0
        if opening is not None and len(chunk):
            n -= len(data.slice(0, skipped).to_pybytes().decode())
            data, opening = data.slice(skipped), None
        sha.update(data)
    return n


def joined_digest(pieces: DataFrame, by: str, order: list[str], text: str, separator: Column, opening: str = "", slice_bytes: int | None = None) -> DataFrame:
    """(by, n_chars, sha256) of the texts of each ``by``: opening, then its pieces in order, before each but the first its separator.  Null pieces are left out."""
    spark, slice_bytes = pieces.sparkSession, slice_bytes or SLICE_BYTES
    keys = [f"o{i}" for i in range(len(order))]
    rows = pieces.select(F.col(by).alias("by"), *[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)], F.concat(separator, F.col(text)).alias("piece"), F.octet_length(separator).alias("lead")).where("piece is not null")
    size = rows.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    place = [F.col(c).asc_nulls_last() for c in ("by", *keys)]
    placed = rows.repartitionByRange(slices, *place).sortWithinPartitions(*place).select("by", "piece", "lead", F.monotonically_increasing_id().alias("n"), F.spark_partition_id().alias("part"))
    kind = dict(rows.dtypes)["by"]
    schema = f"by {kind}, state binary, n_chars bigint, sha string"
    resumable = _library() is not None

    def take(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        state, begun = group["state"][0].as_py(), group["begun"][0].as_py()
        sha = _Resumable(state) if resumable else hashlib.sha256()
        n = _hash(sha, group["piece"].chunks, group["lead"][0].as_py(), opening if state is None else None)
        return pa.table({"by": group["by"].slice(0, 1), "state": pa.array([sha.state.raw if resumable else None], pa.binary()), "n_chars": [begun + n], "sha": [sha.hexdigest()]})

    fresh = lambda df: df.withColumns({"state": F.lit(None).cast("binary"), "begun": F.lit(0).cast("bigint")})
    if slices == 1:
        return fresh(placed).groupBy("by").applyInArrow(take, schema).select(F.col("by").alias(by), "n_chars", F.col("sha").alias("sha256"))
    path = scratch(spark, "pieces")
    with session_settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "8"}):  # a task has one slice: nothing to sort by slice
        placed.write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    if not resumable:
        return _streamed(stored, by, kind, opening)
    turn = (F.row_number().over(Window.partitionBy("by").orderBy("part")) - 1).alias("turn")
    turns = stored.select("by", "part").distinct().select("by", "part", turn)
    turns.write.parquet(f"{path}-turns")
    turns = spark.read.parquet(f"{path}-turns")
    count, last = turns.agg(F.count(F.lit(1)), F.max("turn")).first()
    told = F.broadcast if count <= BROADCAST_SLICES else lambda df: df
    same = lambda a, b: a["by"].eqNullSafe(b["by"])
    whole = None
    for k in range((last or 0) + 1):
        now = turns.where(F.col("turn") == k).select("by", "part")
        parts = [r[0] for r in now.select("part").distinct().collect()]  # slices at most
        some = stored.where(F.col("part").isin(parts))
        mine = told(now.withColumnRenamed("part", "own"))
        some = some.join(mine, same(some, mine) & (some["part"] == mine["own"])).select(some["by"], "piece", "lead", "n")
        if k:
            before = told(spark.read.schema(schema).parquet(f"{path}-step{k - 1}").select("by", "state", F.col("n_chars").alias("begun")))
            some = some.join(before, same(some, before)).select(some["by"], "piece", "lead", "n", "state", "begun")
        else:
            some = fresh(some)
        some.groupBy("by").applyInArrow(take, schema).write.parquet(f"{path}-step{k}")
        done = spark.read.schema(schema).parquet(f"{path}-step{k}").select("by", F.lit(k).alias("k"), "n_chars", "sha")
        whole = done if whole is None else whole.unionByName(done)
    final = whole.groupBy("by").agg(F.max_by(F.struct("n_chars", "sha"), "k").alias("d"))
    return final.select(F.col("by").alias(by), F.col("d.n_chars").alias("n_chars"), F.col("d.sha").alias("sha256"))


def _streamed(stored: DataFrame, by: str, kind: str, opening: str) -> DataFrame:
    """Where no hash can be set aside: a task for each text, which streams through it."""

    def run(batches):
        key, sha, n = None, None, 0
        out = lambda: pa.record_batch({"by": pa.array([key], key_type), "n_chars": pa.array([n], pa.int64()), "sha256": [sha.hexdigest()]})
        for batch in batches:
            names, at, key_type = batch.column(0).to_pylist(), 0, batch.column(0).type
            while at < batch.num_rows:
                end = next((i for i in range(at, batch.num_rows) if names[i] != names[at]), batch.num_rows)
                begins = sha is None or names[at] != key
                if begins:
                    if sha is not None:
                        yield out()
                    key, sha, n = names[at], hashlib.sha256(), 0
                n += _hash(sha, [batch.column(1).slice(at, end - at)], batch.column(2)[at].as_py(), opening if begins else None)
                at = end
        if sha is not None:
            yield out()

    sorted_rows = stored.repartition("by").sortWithinPartitions("by", "part", "n").select("by", "piece", "lead")
    return sorted_rows.mapInArrow(run, f"by {kind}, n_chars bigint, sha256 string").withColumnRenamed("by", by)
