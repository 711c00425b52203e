"""Vectorised word hashing shared by the n-gram operators.

A word is a maximal run of alphanumeric code points (Python's ``str.isalnum``)
or underscores in the lower-cased text.  Every word becomes a 64-bit hash
without a Python-level loop over words: a polynomial prefix hash over the code
points is evaluated once, and each word reads its own hash as a difference of
two prefixes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Code points handled at once; bounds the working memory of a worker.
CHUNK_CHARS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _word_table() -> np.ndarray:
    if "word" not in _tables:
        flags = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.bool_, 0x110000)
        flags[ord("_")] = True
        _tables["word"] = flags
    return _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("power")
    if have is None or len(have) < n:
        size = max(n, CHUNK_CHARS + 1024)
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["power"], _tables["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about CHUNK_CHARS; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text)."""
    joined = "\n".join(t.lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _word_table()[points]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(points) + 1)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return hashes, np.bincount(owner, minlength=len(texts))


def gram_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes in order, n-grams per text).  A text of 1 to n-1 words is one gram of all its words."""
    ends = np.cumsum(counts)
    begins = ends - counts
    per_text = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    total = int(per_text.sum())
    firsts = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(total) - firsts[owner] + begins[owner]
    left = ends[owner] - at
    h = np.zeros(total, np.uint64)
    for j in range(n):
        word = np.zeros(total, np.uint64)
        has = left > j
        word[has] = hashes[at[has] + j]
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(1))
    return h, per_text
