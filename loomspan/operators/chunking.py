"""Chunking of documents for retrieval: by characters, by tokens, by headings.

Each start depends on the previous end, so no window frame expresses it: an Arrow
function folds over one text at a time and hands over a row a chunk.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..storage import give_back

CHUNK = StructType(
    [StructField(n, IntegerType()) for n in ("chunk_index", "char_start", "char_end", "token_start", "token_end")] + [StructField(n, StringType()) for n in ("text", "parent_heading", "section_heading")]
)


def char_chunks(text: str, max_chars: int = 8000, overlap: int = 400) -> list[tuple[int, int]]:
    """Spans of at most max_chars that end at the last line break of their second half, with overlap."""
    max_chars = max(500, max_chars)
    overlap = min(max(0, overlap), max_chars // 2)
    spans, start = [], 0
    while start < len(text):
        end = min(len(text), start + max_chars)
        if end < len(text):
            at = text.rfind("\n", start, end)
            pair = text.rfind("\n\n", start, end)
            cut = max(at, pair)
            end = cut if cut > start + max_chars // 2 else end
        spans.append((start, end))
        if end == len(text):
            return spans
        start = max(end - overlap, start + 1)
    return spans


def token_chunks(spans: list[tuple[int, int]], max_tokens: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """Windows (first token, behind the last) over token spans."""
    max_tokens = max(1, max_tokens)
    overlap = min(max(0, overlap), max_tokens // 2)
    out, start = [], 0
    while start < len(spans):
        end = min(len(spans), start + max_tokens)
        out.append((start, end))
        if end == len(spans):
            break
        start = max(end - overlap, start + 1)
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """The default tokenizer: words and single signs."""
    return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


class BpeSpans:
    """A tokenizer of a byte-level vocabulary: characters that each token covers.

    The rank file (base64 token and rank a line) is given by path and shipped to the workers with ``spark.sparkContext.addFile`` where they don't share it.
    A token that is part of a character covers all of it.
    """

    def __init__(self, vocabulary: str, pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"):
        self.vocabulary, self.pattern, self.encoding = vocabulary, pattern, None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "encoding": None}

    def __call__(self, text: str) -> list[tuple[int, int]]:
        if self.encoding is None:
            import tiktoken

            path = self.vocabulary if os.path.exists(self.vocabulary) else SparkFiles.get(os.path.basename(self.vocabulary))
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            self.encoding = tiktoken.Encoding(os.path.basename(self.vocabulary), pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        starts = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
        spans, at = [], 0
        for token in self.encoding.encode_ordinary(text):
            size = len(self.encoding.decode_single_token_bytes(token))
            spans.append((starts[at], starts[at + size - 1] + 1))
            at += size
        return spans


def semantic_chunks(text: str, max_chars: int = 8000) -> list[dict]:
    """Sections at level 2 and 3 headings outside fences, gathered until half over max_chars."""
    limit = int(max(500, max_chars) * 1.5)
    sections, fenced, parent = [], False, ""
    current = {"start": 0, "level": 0, "parent": ""}
    at = 0
    for line in text.splitlines(keepends=True):
        body = line.lstrip()
        fenced ^= body.startswith("```")
        level = 0 if fenced else 2 if body.startswith("## ") else 3 if body.startswith("### ") else 0
        if level:
            if at > current["start"]:
                sections.append(current | {"end": at})
            parent = body[3:].strip() if level == 2 else parent
            current = {"start": at, "level": level, "parent": parent}
        at += len(line)
    sections.append(current | {"end": len(text)})
    sections = [s for s in sections if text[s["start"] : s["end"]].strip()]
    if not sections:
        return [{"start": 0, "end": len(text), "text": text}] if text else []
    groups: list[list[dict]] = []
    size = 0
    for s in sections:
        length = s["end"] - s["start"]
        if groups and size + length <= limit:
            groups[-1].append(s)
            size += length
        else:
            groups.append([s])
            size = length
    out = []
    for g in groups:
        body = "".join(text[s["start"] : s["end"]] for s in g).lstrip()
        lead = f"## {g[0]['parent']}\n\n"
        if g[0]["level"] == 3 and g[0]["parent"] and not body.startswith(lead):
            body = lead + body
        out.append({"start": g[0]["start"], "end": g[-1]["end"], "text": body})
    return out


def heading_context(text: str) -> tuple[str, str]:
    """(parent heading, section heading) of a chunk."""
    find = lambda mark: next((line[len(mark) :].strip() for line in text.splitlines() if line.startswith(mark)), "")
    parent = find("## ")
    section = next((line.lstrip("#").strip() for line in text.splitlines() if line.startswith(("# ", "### "))), "")
    return parent, section or parent


def _rows(text: str, strategy: str, max_chars: int, overlap: int, max_tokens: int, overlap_tokens: int, tokenizer: Callable) -> list[tuple]:
    if strategy == "tokens":
        spans = tokenizer(text)
        return [(i, spans[a][0], spans[b - 1][1], a, b, text[spans[a][0] : spans[b - 1][1]], None, None) for i, (a, b) in enumerate(token_chunks(spans, max_tokens, overlap_tokens))]
    if strategy == "semantic":
        return [(i, c["start"], c["end"], 0, 0, c["text"], *heading_context(c["text"])) for i, c in enumerate(semantic_chunks(text, max_chars))]
    if strategy == "chars":
        return [(i, a, b, 0, 0, text[a:b], None, None) for i, (a, b) in enumerate(char_chunks(text, max_chars, overlap))]
    raise ValueError("the strategy is chars, tokens or semantic")


#: Characters of texts whose chunks are made before they are handed over.
OUT_CHARACTERS = 1 << 20


def chunk_rows(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), fields: tuple[str, ...] = tuple(CHUNK.names), strategy: str = "chars", max_chars: int = 8000, overlap: int = 400, max_tokens: int = 1000, overlap_tokens: int = 100,
    tokenizer: Callable = word_spans,
) -> DataFrame:
    """(kept columns, fields of CHUNK): a row a chunk, handed over a few texts at a time, so that a worker holds the chunks of those only."""
    schema = StructType([docs.schema[k] for k in keep] + [CHUNK[f] for f in fields])
    places, types = [CHUNK.names.index(f) for f in fields], [pa.string() if CHUNK[f].dataType == StringType() else pa.int32() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, made, size = [], [], 0

            def flush(batch=batch):
                take = pa.array(owner, pa.int64())
                return pa.record_batch([*[batch.column(1 + i).take(take) for i in range(len(keep))], *[pa.array([r[p] for r in made], t) for p, t in zip(places, types, strict=True)]], names=[*keep, *fields])

            for i, value in enumerate(batch.column(0)):
                if t := value.as_py():
                    rows = _rows(t, strategy, max_chars, overlap, max_tokens, overlap_tokens, tokenizer)
                    owner += [i] * len(rows)
                    made += rows
                    size += len(t)
                if size > OUT_CHARACTERS:
                    yield flush()
                    owner, made, size = [], [], 0
            if owner:
                yield flush()
            owner, made = [], []
            give_back()

    return docs.select(text, *keep).mapInArrow(run, schema)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, chunk_index, chunk_total, char_start, char_end, …, text); totals count the chunks of a key."""
    rows = chunk_rows(docs, text, (key,), **options)
    return rows.withColumn("chunk_total", F.count(F.lit(1)).over(Window.partitionBy(key)))
