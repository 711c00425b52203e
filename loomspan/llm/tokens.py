"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, so no section boundary changes how its
text is split.  Each token covers a span of characters (from the byte lengths of
a byte-level vocabulary, which loses nothing); spans are joined to the sections
of the document by interval, and a token across a boundary is allocated by an
explicit rule:

* ``majority`` (default): to the section with most of its characters, the earlier at a tie
* ``start``: to the section of its first character
* ``end``: to the section of its last character

Sections tile the text.  Those of a document are its lines, each with its line
break; ``field_tokens`` takes named columns as the fields of one text instead.
Over the sections of a document, n_tokens always adds up to the tokens of the
whole text; n_crossing counts those of them that also cover another section.

Defined cases
* null text: no sections; empty text: one empty section of 0 tokens
* null doc_id: carried; repeated rows: sections for each
* an empty section (an empty field) never gets a token
* a token that covers part of a character counts as covering it
* very long texts: encoded whole; empty table: no sections; extra columns are ignored
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of a byte-level vocabulary and its splitting pattern; both are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "start", "end")

_encoders: dict[tuple[str, str], tuple] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """(encoding, bytes of each id), made once a worker."""
    key = (vocabulary, pattern)
    if key not in _encoders:
        import tiktoken

        # Where Spark has shipped the file to the workers, their copy is read.
        shipped = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
        with open(shipped if os.path.exists(shipped) else vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[key]


def token_spans(text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Characters (start, end) that each token of the whole text covers."""
    encoding, sizes = encoder(vocabulary, pattern)
    ends = np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text), np.int64)])
    starts = np.concatenate((np.zeros(1, np.int64), ends))[: len(ends)]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[starts], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(n_tokens, n_crossing) of the sections bounds[i] to bounds[i + 1], which tile the text."""
    sections = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    owner = first if rule == "start" else last if rule == "end" else first.copy()
    crossing = first != last
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            inner = np.arange(first[t], last[t] + 1)
            overlap = np.minimum(ends[t], bounds[inner + 1]) - np.maximum(starts[t], bounds[inner])
            owner[t] = inner[int(np.argmax(overlap))]
    return np.bincount(owner, minlength=sections)[:sections], np.bincount(owner[crossing], minlength=sections)[:sections]


def line_bounds(text: str) -> np.ndarray:
    """Bounds of the lines of a text, each with its line break."""
    if "\n" not in text:
        return np.array([0, len(text)], np.int64)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return np.concatenate(([0], breaks, [len(text)] if breaks[-1] < len(text) else np.zeros(0, np.int64))).astype(np.int64)


def _prepare(rows: DataFrame, vocabulary: str, rule: str) -> None:
    """Check the rule and ship the vocabulary, a file of the driver, to the workers."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    rows.sparkSession.sparkContext.addFile(vocabulary)


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each line of each document."""
    _prepare(docs, vocabulary, rule)
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, parts = batch.column(1), 0, []
            for i in range(len(texts)):
                text = texts[i].as_py()
                if text is None:
                    continue
                bounds = line_bounds(text)
                parts.append((i, bounds, *attribute(*token_spans(text, vocabulary, pattern), bounds, rule)))
                size += len(bounds)
                if size > 100_000 or i == len(texts) - 1:
                    yield _rows(batch.column(0), parts, names)
                    size, parts = 0, []
            if parts:
                yield _rows(batch.column(0), parts, names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        count, "doc_id bigint, section int, start bigint, `end` bigint, n_tokens bigint, n_crossing bigint"
    )


def _rows(ids: pa.Array, parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    each = [len(p[1]) - 1 for p in parts]
    return pa.record_batch(
        [
            ids.take(pa.array(np.repeat([p[0] for p in parts], each))),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in each])),
            pa.array(np.concatenate([p[1][:-1] for p in parts])),
            pa.array(np.concatenate([p[1][1:] for p in parts])),
            pa.array(np.concatenate([p[2] for p in parts]).astype(np.int64)),
            pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64)),
        ],
        names=names,
    )


def field_tokens(rows: DataFrame, key: str, fields: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "majority") -> DataFrame:
    """(key, field, n_tokens, n_crossing) of the fields of each row, encoded as one text in the given order; null fields are empty."""
    _prepare(rows, vocabulary, rule)
    kind = dict(rows.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks, names, tokens, crossing = [], [], [], []
            columns = [batch.column(1 + j) for j in range(len(fields))]
            for i in range(batch.num_rows):
                parts = [c[i].as_py() or "" for c in columns]
                bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                n, x = attribute(*token_spans("".join(parts), vocabulary, pattern), bounds, rule)
                picks += [i] * len(fields)
                names += fields
                tokens += n.tolist()
                crossing += x.tolist()
            yield pa.record_batch(
                [batch.column(0).take(pa.array(picks, pa.int64())), pa.array(names, pa.string()), pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64())],
                names=["key", "field", "n_tokens", "n_crossing"],
            )

    return rows.select(F.col(f"`{key}`"), *[F.col(f"`{f}`").cast("string") for f in fields]).mapInArrow(
        count, f"key {kind}, field string, n_tokens bigint, n_crossing bigint"
    ).withColumnRenamed("key", key)
