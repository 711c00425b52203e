"""Media columns: content-addressed payloads in tar shards, described from their headers.

A payload is stored once, under its SHA-256, as a member of a tar shard in the
shared folder.  Rows carry digest, shard, offset and length, never the payload.
Payloads that compress (markup, raw audio) are stored as zstd frames when that is smaller; those that
are compressed already stay as they are.  A frame's first block ends at HEADER_BYTES of the payload, so that
they can be had without what follows.  Metadata columns come from these bytes by ranged reads; no longer
payload is read whole again.

One row of each digest (the one with the lowest id) owns the payload.  Which rows own is decided on
(digest, id) alone; the payload itself is written where it is scanned and crosses no shuffle.
A shard is written under a temporary name and moved into place when complete; its name and
content follow from the scan, so a task that is run again replaces it by the same bytes.

Defined cases
* null payload: a row with null digest and metadata; empty payload: stored as 0 bytes, type ``empty``
* null id: carried, it owns a payload only if no other row has it; repeated rows and equal payloads: rows each, payload once
* headers longer than HEADER_BYTES (pictures behind long profiles, sound behind long notes): read on, from marker to marker
* ids given twice with different payloads: rows each
* unknown or damaged headers: type ``application/octet-stream``, other metadata null
* very long payloads: one member each; a shard is closed when it passes SHARD_BYTES
* empty table: no shards, no rows; extra columns, whatever their names, are ignored
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import local_path, materialise, scratch

SHARD_BYTES = 256 << 20
HEADER_BYTES = 4096
#: What a frame's and a block's own headers take at most.
FRAME_BYTES = 32
#: Rows that do not own their payload are known to every task up to this many; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
INDEX_SCHEMA = "digest string, shard string, shard_offset bigint, stored_length bigint, size bigint, encoding string"
HEADER_SCHEMA = "media_type string, width int, height int, channels int, sample_rate int, duration_ms bigint, charset string, language string"
_HEADER_FIELDS = [(f.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in HEADER_SCHEMA.split(", ")]


def describe(head: bytes, size: int, read: Callable[[int, int], bytes] | None = None) -> dict:
    """Metadata from the first bytes of a payload of ``size`` bytes; read(at, n) gives n bytes of it from further on."""
    more = lambda at, n: head[at : at + n] if at + n <= len(head) or read is None else read(at, n)
    try:
        return _describe(head, size, more)
    except (struct.error, IndexError, ValueError, UnicodeDecodeError):
        return {"media_type": "application/octet-stream"}


def _describe(head: bytes, size: int, more: Callable[[int, int], bytes]) -> dict:
    if not size:
        return {"media_type": "empty"}
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        width, height, _, colour = struct.unpack(">IIBB", head[16:26])
        return {"media_type": "image/png", "width": width, "height": height, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)}
    if head[:6] in (b"GIF87a", b"GIF89a"):
        width, height = struct.unpack("<HH", head[6:10])
        return {"media_type": "image/gif", "width": width, "height": height, "channels": 1}
    if head[:2] == b"BM" and size >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return {"media_type": "image/bmp", "width": width, "height": abs(height)}
    if head[:3] == b"\xff\xd8\xff":
        at, part = 2, head[2:12]
        while len(part) >= 4 and part[0] == 0xFF:
            marker, length = part[1], struct.unpack(">H", part[2:4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", part[5:9])
                return {"media_type": "image/jpeg", "width": width, "height": height, "channels": part[9]}
            at += 1 if marker == 0xFF else 2 + length
            part = more(at, 10)
        return {"media_type": "image/jpeg"}
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        at, found = 12, {"media_type": "audio/wav"}
        rate = 0
        while len(part := more(at, 20)) >= 8:
            name, length = part[:4], struct.unpack("<I", part[4:8])[0]
            if name == b"fmt ":
                _, found["channels"], found["sample_rate"], rate = struct.unpack("<HHII", part[8:20])
            elif name == b"data":
                found["duration_ms"] = min(length, size - at - 8) * 1000 // rate if rate else None
                break
            at += 8 + length + length % 2
        return found
    if head[:4] == b"%PDF":
        return {"media_type": "application/pdf"}
    if re.match(rb"\s*(?:<!doctype html|<html)", head, re.I):
        found = {"media_type": "text/html"}
        if m := re.search(rb"<meta[^>]*charset\s*=\s*[\"']?([\w-]+)", head, re.I):
            found["charset"] = m[1].decode("ascii").lower()
        if m := re.search(rb"<html[^>]*\slang\s*=\s*[\"']?([\w-]+)", head, re.I):
            found["language"] = m[1].decode("ascii").lower()
        return found
    try:
        head[: max(0, len(head) - 3)].decode("utf-8")
        return {"media_type": "text/plain"} if b"\0" not in head else {"media_type": "application/octet-stream"}
    except UnicodeDecodeError:
        return {"media_type": "application/octet-stream"}


class _Shards:
    """The tar shards one task writes."""

    def __init__(self, folder: str, task: int, attempt: int, shard_bytes: int, header_bytes: int = HEADER_BYTES):
        self.folder, self.task, self.attempt, self.limit, self.number, self.out = folder, task, attempt, shard_bytes, 0, None
        self.squeeze, self.header_bytes = zstandard.ZstdCompressor(level=3), header_bytes

    def _frame(self, payload: bytes) -> bytes:
        if len(payload) <= self.header_bytes:
            return self.squeeze.compress(payload)
        out = self.squeeze.compressobj(size=len(payload))
        head = out.compress(payload[: self.header_bytes]) + out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        return head + out.compress(payload[self.header_bytes :]) + out.flush()

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int, int, str]:
        """(shard, offset, stored length, size, encoding)."""
        stored, encoding = payload, "raw"
        if len(payload) > 64 and len(packed := self._frame(payload)) < 0.9 * len(payload):
            stored, encoding = packed, "zstd"
        if self.out is None:
            self.name = f"shard-{self.task:06d}-{self.number:04d}.tar"
            self.temporary = os.path.join(self.folder, f".{self.name}.{self.attempt}")
            self.out = open(self.temporary, "wb")  # noqa: SIM115
        header = tarfile.TarInfo(digest + (".zst" if encoding == "zstd" else ""))
        header.size = len(stored)
        self.out.write(header.tobuf(tarfile.USTAR_FORMAT))
        place = (self.name, self.out.tell(), len(stored), len(payload), encoding)
        self.out.write(stored)
        self.out.write(b"\0" * (-len(stored) % tarfile.BLOCKSIZE))
        if self.out.tell() >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            os.replace(self.temporary, os.path.join(self.folder, self.name))
            self.out, self.number = None, self.number + 1


def store_media(rows: DataFrame, id_column: str, payload_column: str, shard_bytes: int = SHARD_BYTES, header_bytes: int = HEADER_BYTES) -> tuple[DataFrame, DataFrame, str]:
    """(rows of id and digest, index of digest to place, folder of the shards)."""
    spark = rows.sparkSession
    folder = scratch(spark, "media")
    os.makedirs(local_path(folder), exist_ok=True)
    payload = F.col(f"`{payload_column}`")
    payload = payload if dict(rows.dtypes)[payload_column] == "binary" else F.encode(payload.cast("string"), "UTF-8")
    keyed = rows.select(F.col(f"`{id_column}`").alias("id"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    digests = materialise(keyed.select("id", "digest"), "media-rows")
    owners = digests.where("digest is not null").groupBy("digest").agg(F.min("id").alias("owner"))
    others = digests.join(owners, "digest").where("not (id <=> owner)").select("id", "digest").distinct()
    others = materialise(others, "media-others")
    owned = keyed.where("payload is not null")
    small = others.count() <= BROADCAST_ROWS
    if small:
        owned = owned.join(F.broadcast(others), (owned["id"].eqNullSafe(others["id"])) & (owned["digest"] == others["digest"]), "left_anti")
    else:
        owned = owned.join(others, (owned["id"].eqNullSafe(others["id"])) & (owned["digest"] == others["digest"]), "left_anti")
    target = local_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shards = _Shards(target, context.partitionId(), context.taskAttemptId(), shard_bytes, header_bytes)
        seen: set[str] = set()  # rows repeated in full: the payload goes in once a task
        for batch in batches:
            digests, payloads, out = batch.column(0), batch.column(1), []
            for i in range(batch.num_rows):
                digest = digests[i].as_py()
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, *shards.add(digest, payloads[i].as_py())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        shards.close()

    written = materialise(owned.select("digest", "payload").mapInArrow(write, INDEX_SCHEMA), "media-index")
    place = F.struct("shard", "shard_offset", "stored_length", "size", "encoding")
    index = written.groupBy("digest").agg(F.min(place).alias("p")).select("digest", "p.*")
    return digests, index, folder


def read_payload(folder: str, shard: str, offset: int, stored_length: int, encoding: str, limit: int | None = None) -> bytes:
    """The payload, or its first ``limit`` bytes from ranged reads of about as many until they are out."""
    with open(os.path.join(local_path(folder), shard), "rb", buffering=0) as f:
        f.seek(offset)
        if limit is None:
            data = f.read(stored_length)
            return data if encoding == "raw" else zstandard.ZstdDecompressor().decompress(data)
        if encoding == "raw":
            return f.read(min(stored_length, limit))
        frame, plain, left = zstandard.ZstdDecompressor().decompressobj(), b"", stored_length
        while left > 0 and len(plain) < limit and (data := f.read(min(left, limit + FRAME_BYTES))):
            plain, left = plain + frame.decompress(data), left - len(data)
        return plain[:limit]


def read_part(folder: str, shard: str, offset: int, stored_length: int, encoding: str, at: int, n: int) -> bytes:
    """n bytes of the payload from a place on: a ranged read of a raw one; of a compressed one what precedes is read, too."""
    if encoding != "raw":
        return read_payload(folder, shard, offset, stored_length, encoding, at + n)[at : at + n]
    with open(os.path.join(local_path(folder), shard), "rb", buffering=0) as f:
        f.seek(offset + at)
        return f.read(max(0, min(n, stored_length - at)))


def read_headers(index: DataFrame, folder: str, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """The index with the columns of HEADER_SCHEMA, filled from ranged reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [None] * len(rows)
            for i in sorted(range(len(rows)), key=lambda i: (rows[i]["shard"], rows[i]["shard_offset"])):
                r = rows[i]
                place = folder, r["shard"], r["shard_offset"], r["stored_length"], r["encoding"]
                found[i] = describe(read_payload(*place, header_bytes), r["size"], lambda at, n, place=place: read_part(*place, at, n))
            added = [pa.array([f.get(name) for f in found], kind) for name, kind in _HEADER_FIELDS]
            yield pa.record_batch([*batch.columns, *added], names=[*batch.schema.names, *[name for name, _ in _HEADER_FIELDS]])

    return index.mapInArrow(run, f"{INDEX_SCHEMA}, {HEADER_SCHEMA}")


def media_columns(rows: DataFrame, id_column: str, payload_column: str, shard_bytes: int = SHARD_BYTES, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """(id, digest, place in the shards, metadata), a row for each row."""
    digests, index, folder = store_media(rows, id_column, payload_column, shard_bytes, header_bytes)
    described = read_headers(index, folder, header_bytes)
    return digests.join(described, "digest", "left").select(F.col("id").alias(id_column), "digest", *[c for c in described.columns if c != "digest"])
