"""Integer columns as small blobs, for shuffles of many hashes.

A blob holds columns of unsigned integers of equal or different lengths.  A sorted
column is stored as differences, every column as byte planes of its own width, and
the whole as one zstd frame.  Hashes that are sorted within a slice of their range
take less than half of their plain size that way.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_local: dict[str, object] = {}


def encode(columns: list[np.ndarray], sorted_columns: tuple[int, ...] = ()) -> bytes:
    parts = [struct.pack("<I", len(columns))]
    for i, column in enumerate(columns):
        values = np.ascontiguousarray(column, np.uint64)
        if i in sorted_columns and len(values):
            values = np.concatenate((values[:1], np.diff(values)))
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        parts.append(struct.pack("<QBB", len(values), width, i in sorted_columns))
        parts.append(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    if "c" not in _local:
        _local["c"] = zstandard.ZstdCompressor(level=1)
    return _local["c"].compress(b"".join(parts))


def decode(blob: bytes) -> list[np.ndarray]:
    if "d" not in _local:
        _local["d"] = zstandard.ZstdDecompressor()
    data = _local["d"].decompress(blob)
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        n, width, is_sorted = struct.unpack_from("<QBB", data, at)
        at += 10
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        values = wide.view(np.uint64).ravel()
        out.append(np.cumsum(values, dtype=np.uint64) if is_sorted else values)
    return out


def slices(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bounds in sorted ``bits``-bit hashes of ``buckets`` equal slices of their range."""
    cuts = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, cuts, "left"), len(hashes))


def slice_of(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    cuts = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.searchsorted(cuts, hashes, "right")
