"""Perplexity under an interpolated modified Kneser-Ney n-gram model of the whole corpus.

Tokens are words (see ``words``) by their numbers in the vocabulary; ``order`` - 1 start marks stand before a document and an end mark
behind it.  With h for the words before w, and h' for h without its first word:

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h.) + g(h) p(w | h')
    p(w)     = max(a(w) - D'(a(w)), 0) / A + g' / (V + 1)

In the highest order c are counts of all documents; below it c(hw) is the number of distinct words before hw.  a(w) is
the number of distinct words that w follows, A their sum, V the number of words with the end mark (one more shares in
the rest: any unknown word).  Every order has one discount each for counts of one, two, and three or more, from its
counts of counts; g(h) and g' hand on what was discounted.  A context that was never seen leaves it to the next shorter.

Vocabulary: each task sends its distinct words (64-bit hashes) with counts to the slice of their hash range.  A slice
writes a sorted hash array with the number of each word: its rank by frequency among the words of the
slice, times the slices, plus the slice, so that numbers are dense and frequent words have low ones.

Counting: each task combines the n-grams of a block of documents and sends them as blobs to the slice of their context.  A context of
one or two words is its numbers put through a bijection, which spreads them evenly over the slices and keeps them apart for
certain; a longer one is a 64-bit hash.  A slice sums its n-grams and writes its part of the model to the shared folder: contexts as a
sorted hash array of which the leading bits are a directory, and the successors of each as sorted word numbers with counts;
contexts of a single successor hold it at their own place.  Its distinct n-grams without their first word
go to the slices of the next lower order, which count and write them in the same way, down to single words.
Only a few numbers a slice reach the driver.  Scoring maps these files into memory and looks
up the n-grams of a block together, in hash order.

Files are written under a temporary name and moved into place, and their content
follows from the input, so tasks can be run again.

Defined cases
* null or empty text, or one without words: no tokens, null log_prob and perplexity; adds nothing to the counts
* null doc_id: carried; repeated rows: counted and scored each
* very long texts: a block of their own, whole
* empty table: no model parts, no rows; extra columns are ignored
* too few counts of counts for a discount: the nearest admissible value, 0 to the count itself
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .store import local_path, materialise, scratch, slices_for
from .words import chunks, mix, word_hashes

#: Numbers that are no word's: unknown words, and the marks.
UNKNOWN, START, END, FIRST = (np.uint64(x) for x in range(4))
BLOCK_TOKENS = 1_200_000
#: Bytes behind a narrow column, so that its last number can be read by the next machine width.
BEHIND = 8
#: Distinct words that a task collects before it sends them.
BLOCK_WORDS = 600_000
STATS = "part string, slice int, target int, piece binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n3plus bigint, total bigint, types bigint"


def word_sequence(texts: list[str], order: int, number: Callable[[np.ndarray], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the first to the last word of every n-gram, n-grams a text) with marks; a text without words has none."""
    hashes, counts = word_hashes(texts)
    words = number(hashes)
    per_text = np.where(counts > 0, counts + 1, 0)
    padded = np.where(counts > 0, counts + order, 0)
    begins = np.cumsum(padded) - padded
    flat = np.full(int(padded.sum()), START)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(words)) - (np.cumsum(counts) - counts)[owner]
    flat[begins[owner] + order - 1 + inside] = words
    flat[(begins + padded)[counts > 0] - 1] = END
    owner = np.repeat(np.arange(len(per_text)), per_text)
    at = begins[owner] + np.arange(len(owner)) - (np.cumsum(per_text) - per_text)[owner]
    return [flat[at + i] for i in range(order)], per_text


_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of ``bits`` bits that looks random."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in _ODD:
        x = x * np.uint64(odd) & mask
        x = x ^ x >> half
    return x


def gather(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``spread``."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in reversed(_ODD):
        x = x ^ x >> half
        x = x * np.uint64(pow(odd, -1, 1 << 64)) & mask
    return x


def context_bits(words: int, bits: int) -> int:
    return words * bits if words <= 2 else 64


def context_key(words: list[np.ndarray], bits: int) -> np.ndarray:
    """The key of one or more words in order: a bijection of one or two numbers of ``bits`` bits, else a hash."""
    if len(words) <= 2:
        joined = words[0] if len(words) == 1 else words[0] << np.uint64(bits) | words[1]
        return spread(joined, context_bits(len(words), bits))
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = mix(h * np.uint64(_ODD[1]) + w + np.uint64(1))
    return h


def distinct_ngrams(context: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct n-gram in order of (context, word), its count)."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    if counts is None:
        summed = np.diff(np.concatenate((at, [len(order)])))
    else:
        summed = np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)
    return order[at], summed.astype(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _encode(context: np.ndarray, middle: list[np.ndarray], word: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct n-grams in order; middle are a context's words but its first, where its key doesn't give them."""
    at = _runs(context)
    return blobs.encode([context[at], np.diff(np.concatenate((at, [len(context)]))), word, counts, *[m[at] for m in middle]], (0,))


def _decode(blob: bytes) -> list[np.ndarray]:
    """[context, middle words ..., word, count]."""
    context, lengths, word, counts, *middle = blobs.decode(blob)
    lengths = lengths.astype(np.int64)
    return [np.repeat(context, lengths), *[np.repeat(m, lengths) for m in middle], word, counts.astype(np.int64)]


def _pieces(words: list[np.ndarray], counts: np.ndarray | None, bits: int, n_slices: int) -> Iterator[tuple[int, bytes]]:
    """(slice, blob) of n-grams, equal ones summed."""
    context, word, middle = context_key(words[:-1], bits), words[-1], words[1:-1] if len(words) > 3 else []
    keep, summed = distinct_ngrams(context, word, counts)
    context, middle, word = context[keep], [m[keep] for m in middle], word[keep]
    bounds = blobs.slices(context, context_bits(len(words) - 1, bits), n_slices)
    for s in range(n_slices):
        a, b = bounds[s], bounds[s + 1]
        if a < b:
            yield s, _encode(context[a:b], [m[a:b] for m in middle], word[a:b], summed[a:b])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    """[n1, n2, n3, n4, n3plus]."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    return [int(n[1]), int(n[2]), int(n[3]), int(n[4]), int(n[3] + n[4] + n[5])]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, 0.0, [0.0, 1.0, 2.0, 3.0])


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of all columns, moved into place when whole."""
    path = os.path.join(folder, name)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    head = json.dumps([[key, value.dtype.str, len(value)] for key, value in arrays.items()]).encode()
    with open(temporary, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        for value in arrays.values():
            f.write(b"\0" * (-f.tell() % 8) + value.tobytes())
    os.replace(temporary, path)


def _load(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    at = 8 + int(data[:8].view(np.uint64)[0])
    out = {}
    for key, kind, length in json.loads(data[8:at].tobytes()):
        at += -at % 8
        size = length * np.dtype(kind).itemsize
        out[key] = data[at : at + size].view(kind)
        at += size
    return out


def _compact(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as single bytes; 255 stands for an entry of the sorted overflow."""
    big = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": big.astype(np.int64), f"{name}_big": counts[big].astype(np.int64)}


def _counts(part: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    counts = part[name][at].astype(np.int64)
    big = np.flatnonzero(counts == 255)
    if len(big):
        counts[big] = part[f"{name}_big"][np.searchsorted(part[f"{name}_at"], at[big])]
    return counts


def _narrow(name: str, values: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Numbers of ``width`` bytes, and bytes behind the last that are read with it."""
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].ravel()
    return {name: np.concatenate((rows, np.zeros(BEHIND, np.uint8))), f"{name}_width": np.array([width], np.int64)}


def _numbers(part: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.unsignedinteger]:
    """(the numbers of a narrow column where they lie, each with the bytes up to the next machine width, a mask of its own)."""
    width, data = int(part[f"{name}_width"][0]), part[name]
    numbers = np.ndarray((len(data) - BEHIND) // width, f"<u{1 << (width - 1).bit_length()}", data, strides=(width,))
    return numbers, numbers.dtype.type((1 << 8 * width) - 1)


def _wide(part: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    numbers, own = _numbers(part, name)
    return numbers[at] & own


def _keys(name: str, keys: np.ndarray, slice_: int, bits: int, n_slices: int) -> dict[str, np.ndarray]:
    """Sorted keys of a slice: their leading bits as a directory of where they begin, the rest as bytes."""
    base = (slice_ << bits) // n_slices
    room = max(1, ((slice_ + 1) << bits) // n_slices - base)
    low = max(0, -(-max(0, room.bit_length() - max(1, len(keys)).bit_length()) // 8)) * 8
    own = keys - np.uint64(base)
    directory = np.searchsorted(own >> np.uint64(low), np.arange((room >> low) + 2, dtype=np.uint64))
    kind = np.uint32 if len(keys) < 1 << 32 else np.int64
    return {f"{name}_base": np.array([base, low], np.uint64), f"{name}_dir": directory.astype(kind), **_narrow(f"{name}_low", own & np.uint64((1 << low) - 1), max(1, low // 8))}


def _find(part: dict[str, np.ndarray], name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the keys, whether it is there)."""
    base, low = part[f"{name}_base"]
    own = wanted - base
    directory = part[f"{name}_dir"]
    if len(directory) < 2 or not int(directory[-1]):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    bucket = np.minimum((own >> low).astype(np.int64), len(directory) - 2)
    return _ragged(part, f"{name}_low", directory[bucket].astype(np.int64), directory[bucket + 1].astype(np.int64), own & np.uint64((1 << int(low)) - 1))


def _ragged(part: dict[str, np.ndarray], name: str, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) by binary search for wanted[i], a number of the column's width, among the sorted numbers begin[i] to end[i]."""
    numbers, own = _numbers(part, name)
    inside = np.flatnonzero(begin < end)
    # Ranges that take more halvings come first: those that are still open are a prefix.
    halvings = np.frexp(end[inside] - begin[inside] - 1.0)[1].astype(np.int8)
    order = inside[np.argsort(-halvings, kind="stable")]
    a, length, sought = begin[order], (end - begin)[order], wanted[order].astype(numbers.dtype)
    for k in len(order) - np.cumsum(np.bincount(halvings))[:-1]:
        half = length[:k] >> 1
        middle = a[:k] + half
        np.copyto(a[:k], middle, where=numbers[middle] & own <= sought[:k])
        length[:k] -= half
    place, known = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
    known[order] = hit = numbers[a] & own == sought
    place[order] = np.where(hit, a, 0)
    return place, known


def _stats(part: str, slice_: int, numbers: list[int], total: int, types: int) -> dict:
    return dict(zip(("part", "slice", "target", "piece", "n1", "n2", "n3", "n4", "n3plus", "total", "types"), (part, slice_, -1, None, *numbers, total, types), strict=True))


@dataclass
class Trained:
    folder: str
    slices: int
    order: int
    bits: int
    discount: dict[int, np.ndarray]
    low_discount: np.ndarray
    continuations: int
    vocabulary: int
    low_rest: float


class Vocabulary:
    """Word numbers from the sorted hash arrays, mapped into memory."""

    def __init__(self, folder: str, slices: int):
        self.folder, self.slices = folder, slices
        self.parts: dict[int, dict[str, np.ndarray] | None] = {}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(hashes, return_inverse=True)
        numbers = np.full(len(distinct), UNKNOWN)
        bounds = blobs.slices(distinct, 64, self.slices)
        for t in np.flatnonzero(np.diff(bounds)):
            if t not in self.parts:
                path = os.path.join(self.folder, f"vocabulary-{t}")
                self.parts[t] = _load(path) if os.path.exists(path) else None
            part = self.parts[t]
            if part:
                some = distinct[bounds[t] : bounds[t + 1]]
                at = np.minimum(np.searchsorted(part["key"], some), len(part["key"]) - 1)
                numbers[bounds[t] : bounds[t + 1]] = np.where(part["key"][at] == some, part["number"][at], UNKNOWN)
        return numbers[place]


def _count_words(docs: DataFrame, folder: str, n_slices: int) -> int:
    """Write the vocabulary; the bits of its numbers."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal words, counts, held, size
            some, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            words, place = np.unique(np.concatenate((words, some)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)).astype(np.float64), len(words)).astype(np.int64)
            held, size = [], 0

        def flush() -> pa.RecordBatch:
            bounds = blobs.slices(words, 64, n_slices)
            out = [(t, blobs.encode([words[a:b], counts[a:b]], (0,))) for t, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
            return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["target", "piece"])

        for batch in batches:
            for _, texts in chunks(x.as_py() for x in batch.column(0)):
                held.append(word_hashes(texts)[0])
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    fold()
                    if len(words) >= BLOCK_WORDS:
                        yield flush()
                        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fold()
        if len(words):
            yield flush()

    def number(group: pa.Table) -> pa.Table:
        t = group.column("target")[0].as_py()
        pieces = [blobs.decode(x.as_py()) for x in group.column("piece")]
        words, place = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in pieces]).astype(np.float64), len(words))
        rank = np.empty(len(words), np.uint64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint64)
        numbers = FIRST + rank * np.uint64(n_slices) + np.uint64(t)
        _save(local_path(folder), f"vocabulary-{t}", {"key": words, "number": numbers.astype(np.uint32 if int(numbers.max()) < 1 << 32 else np.uint64)})
        return pa.table({"most": pa.array([int(numbers.max())], pa.int64())})

    texts = docs.select("text").where("text is not null")
    most = materialise(texts.mapInArrow(words_of, "target int, piece binary").groupBy("target").applyInArrow(number, "most bigint"), "lm-vocabulary").agg(F.max("most")).first()[0]
    bits = int(most or FIRST).bit_length()
    if bits > 32:
        raise ValueError("more than four thousand million distinct words")
    return bits


def train(docs: DataFrame, order: int = 2) -> Trained:
    """Count every document and write the model of n-grams of ``order`` words, 2 or more, to the shared folder."""
    if order < 2:
        raise ValueError(f"the order is 2 or more, not {order}")
    n_slices = slices_for(docs, "text")
    uri = scratch(docs.sparkSession, "lm")
    folder = local_path(uri)
    os.makedirs(folder, exist_ok=True)
    bits = _count_words(docs, uri, n_slices)
    width = (bits + 7) // 8

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Vocabulary(folder, n_slices)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            out = list(_pieces(words, None, bits, n_slices))
            return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["target", "piece"])

        for batch in batches:
            for _, texts in chunks(x.as_py() for x in batch.column(0)):
                words, per_text = word_sequence(texts, order, number)
                held.append(words)
                size += int(per_text.sum())
                if size >= BLOCK_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def sum_level(level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: sum_slice(level, table.drop_columns("group"))

    def sum_slice(level: int, group: pa.Table) -> pa.Table:
        s = group.column("target")[0].as_py()
        if s < 0:
            return group
        context, *middle, word, counts = _sum_pieces(group.column("piece"))
        at = _runs(context)
        ends = np.concatenate((at[1:], [len(context)]))
        add = lambda x: np.add.reduceat(x.astype(np.int64), at)
        lone = ends - at == 1
        several = np.repeat(~lone, ends - at)
        key_bits, keys = context_bits(level - 1, bits), context[at]
        offsets = np.concatenate(([0], np.cumsum((ends - at)[~lone])))
        _save(folder, f"level{level}-{s}", {
            **_keys("one", keys[lone], s, key_bits, n_slices), **_narrow("one_word", word[at[lone]], width), **_compact("one_count", counts[at[lone]]),
            **_keys("key", keys[~lone], s, key_bits, n_slices), "offset": offsets.astype(np.uint32 if len(context) < 1 << 32 else np.int64),
            **_compact("total", add(counts)[~lone]), **_compact("n1", add(counts == 1)[~lone]), **_compact("n2", add(counts == 2)[~lone]), **_narrow("word", word[several], width), **_compact("count", counts[several]),
        })
        rows = [_stats(f"level{level}", s, counts_of_counts(counts), int(counts.sum()), len(counts))]
        if level > 2:
            if level == 3:
                middle = [gather(context, key_bits) & np.uint64((1 << bits) - 1)]
            lower = _pieces([*middle, word], np.ones(len(word), np.int64), bits, n_slices)
        else:
            keys, follows = np.unique(spread(word, bits), return_counts=True)
            bounds = blobs.slices(keys, bits, n_slices)
            lower = ((t, blobs.encode([keys[a:b], follows[a:b]], (0,))) for t, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b)
        rows += [_stats("piece", s, [0] * 5, 0, 0) | {"target": t, "piece": piece} for t, piece in lower]
        return _table(rows)

    def sum_words(group: pa.Table) -> pa.Table:
        t = group.column("target")[0].as_py()
        if t < 0:
            return group
        pieces = [blobs.decode(x.as_py()) for x in group.column("piece")]
        keys, place = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        follows = np.bincount(place, np.concatenate([p[1] for p in pieces]).astype(np.float64), len(keys)).astype(np.int64)
        _save(folder, f"word-{t}", {**_keys("key", keys, t, bits, n_slices), "follows": follows.astype(np.uint32 if follows.max() < 1 << 32 else np.int64)})
        return _table([_stats("word", t, counts_of_counts(follows), int(follows.sum()), len(keys))])

    summed = docs.select("text").where("text is not null").mapInArrow(count_blocks, "target int, piece binary").withColumn("group", F.col("target"))
    for level in range(order, 1, -1):
        summed = summed.groupBy("group").applyInArrow(sum_level(level), STATS)
        # Statistics rows have target -1; they are spread by slice so that no group gathers them all.
        summed = summed.withColumn("group", F.when(F.col("target") < 0, -1 - F.col("slice")).otherwise(F.col("target")))
    stats = materialise(summed.groupBy("group").applyInArrow(lambda table: sum_words(table.drop_columns("group")), STATS), "lm-stats")
    numbers = ["n1", "n2", "n3", "n4", "n3plus", "total", "types"]
    sums = {r["part"]: r for r in stats.groupBy("part").agg(*[F.sum(c).alias(c) for c in numbers]).collect()}
    low = sums.get("word")
    if low is None:
        return Trained(uri, n_slices, order, bits, {k: discounts(0, 0, 0, 0) for k in range(2, order + 1)}, discounts(0, 0, 0, 0), 0, 0, 1.0)
    d = {part: discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for part, r in sums.items()}
    e = d["word"]
    rest = float(e[1] * low["n1"] + e[2] * low["n2"] + e[3] * low["n3plus"]) / low["total"]
    return Trained(uri, n_slices, order, bits, {k: d[f"level{k}"] for k in range(2, order + 1)}, e, int(low["total"]), int(low["types"]), rest)


def _sum_pieces(pieces: pa.ChunkedArray) -> list[np.ndarray]:
    """[context, middle words ..., word, count] of the distinct n-grams of all pieces, in order."""
    columns = [np.concatenate(x) for x in zip(*(_decode(p.as_py()) for p in pieces), strict=True)]
    keep, counts = distinct_ngrams(columns[0], columns[-2], columns[-1])
    return [*(c[keep] for c in columns[:-1]), counts]


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"part": pa.string(), "slice": pa.int32(), "target": pa.int32(), "piece": pa.binary()}
    return pa.table({name: pa.array([r[name] for r in rows], kinds.get(name, pa.int64())) for name in rows[0]})


class Reader:
    """The model files mapped into memory."""

    def __init__(self, model: Trained):
        self.model, self.folder = model, local_path(model.folder)
        self.parts: dict[str, dict[str, np.ndarray] | None] = {}

    def part(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.parts:
            path = os.path.join(self.folder, name)
            self.parts[name] = _load(path) if os.path.exists(path) else None
        return self.parts[name]

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """p(w) of distinct words."""
        m = self.model
        keys = spread(words, m.bits)
        order = np.argsort(keys)
        follows, keys = np.zeros(len(words), np.int64), keys[order]
        bounds = blobs.slices(keys, m.bits, m.slices)
        for t in np.flatnonzero(np.diff(bounds)):
            part = self.part(f"word-{t}")
            if part:
                at, known = _find(part, "key", keys[bounds[t] : bounds[t + 1]])
                follows[order[bounds[t] : bounds[t + 1]]] = np.where(known, part["follows"][at], 0)
        rest = m.low_rest / (m.vocabulary + 1)
        return np.maximum(follows - m.low_discount[np.minimum(follows, 3)], 0) / max(1, m.continuations) + rest

    def probability(self, words: list[np.ndarray]) -> np.ndarray:
        """p of the last word of each n-gram after the others."""
        distinct, place = np.unique(words[-1], return_inverse=True)
        p = self.unigram(distinct)[place]
        for level in range(2, self.model.order + 1):
            context = context_key(words[-level:-1], self.model.bits)
            order = np.argsort(context)
            p[order] = self._interpolate(level, context[order], words[-1][order], p[order])
        return p

    def _interpolate(self, level: int, context: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p in one order, in order of the contexts, from that in the order below."""
        m, out = self.model, low.copy()
        d = m.discount[level]
        bounds = blobs.slices(context, context_bits(level - 1, m.bits), m.slices)
        for s in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[s], bounds[s + 1]
            part = self.part(f"level{level}-{s}")
            if not part:
                continue
            begins = _runs(context[a:b])
            each, back = context[a:b][begins], np.repeat(np.arange(len(begins)), np.diff(np.concatenate((begins, [b - a]))))
            total, n1, n2, types = (np.ones(len(each), np.int64) for _ in range(4))
            counts = np.zeros(b - a, np.int64)
            at, lone = _find(part, "one", each)
            if lone.any():
                single = _counts(part, "one_count", at[lone])
                total[lone], n1[lone], n2[lone] = single, single == 1, single == 2
                mine = np.flatnonzero(lone[back])
                hit = _wide(part, "one_word", at[back[mine]]) == word[a:b][mine]
                counts[mine] = np.where(hit, total[back[mine]], 0)
            some = np.flatnonzero(~lone)
            place, known = _find(part, "key", each[some])
            many, place = some[known], place[known]
            if len(many):
                total[many], n1[many], n2[many] = (_counts(part, name, place) for name in ("total", "n1", "n2"))
                begin, end = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
                begin[many], end[many] = part["offset"][place], part["offset"][place + 1]
                types[many] = end[many] - begin[many]
                found = np.zeros(len(each), bool)
                found[many] = True
                mine = np.flatnonzero(found[back])
                spot, hit = _ragged(part, "word", begin[back[mine]], end[back[mine]], word[a:b][mine])
                counts[mine[hit]] = _counts(part, "count", spot[hit])
            seen = lone.copy()
            seen[many] = True
            rest = (d[1] * n1 + d[2] * n2 + d[3] * (types - n1 - n2)) / total
            p = np.maximum(counts - d[np.minimum(counts, 3)], 0) / total[back] + rest[back] * low[a:b]
            out[a:b] = np.where(seen[back], p, low[a:b])
        return out


def score(docs: DataFrame, model: Trained) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of each row; n_tokens counts the end mark, log_prob is natural."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, number = Reader(model), Vocabulary(local_path(model.folder), model.slices)
        for batch in batches:
            held, size = [], 0
            for start, some in chunks(x.as_py() for x in batch.column(1)):
                held.append((start, *word_sequence(some, model.order, number)))
                size += int(held[-1][2].sum())
                if size >= BLOCK_TOKENS:
                    yield rows(batch, reader, held)
                    held, size = [], 0
            if held:
                yield rows(batch, reader, held)

    def rows(batch: pa.RecordBatch, reader: Reader, held: list[tuple]) -> pa.RecordBatch:
        words, per_text = [np.concatenate(x) for x in zip(*(h[1] for h in held), strict=True)], np.concatenate([h[2] for h in held])
        p = reader.probability(words)
        owner = np.repeat(np.arange(len(per_text)), per_text)
        log_prob = np.bincount(owner, np.log(p), len(per_text))
        empty = per_text == 0
        ids = batch.column(0).slice(held[0][0], len(per_text))
        return pa.record_batch(
            [ids, pa.array(per_text.astype(np.int64)), pa.array(log_prob, mask=empty), pa.array(np.exp(-log_prob / np.maximum(per_text, 1)), mask=empty)],
            names=["doc_id", "n_tokens", "log_prob", "perplexity"],
        )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, log_prob double, perplexity double")


def perplexity(docs: DataFrame, order: int = 2) -> DataFrame:
    """Every document scored by the model of all documents."""
    return score(docs, train(docs, order))
