"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (4 and 5 characters, hashed)
of its lower-cased form in which every run of other than word characters is one
space, so an n-gram can start or end at a word's edge.  Feature j is scaled by
``r_j = log((p_j / |p|) / (q_j / |q|))`` of its smoothed counts in toxic and clean
training documents, the scaled vector has unit length in each passage, and
logistic regression is fitted on it.

Toxic language may be a few words of a long text, so a document is scored by
passages: consecutive windows of ``PASSAGE`` characters that overlap by ``OVERLAP``, over the
whole text.  Training is in two rounds: round one learns from whole documents;
round two learns from the highest-scoring passage of each toxic document and of
each clean one.  The document's score is that of its highest-scoring passage.

Defined cases
* null or empty text, or one without word characters: score 0.0, not toxic
* null doc_id: scored like any other; repeated rows: scored each
* very long texts: every passage is scored, none is cut off
* no usable labels (one class missing): an error, as nothing can be learned
* labels given twice for a document: toxic if any of them is; null labels are not used
* a labelled document of several rows: its first text in order is learned from
* empty documents: an empty result; extra columns, whatever their names, pass through the filter untouched
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import _word_table

BITS = 18
SIZES = (4, 5)
PASSAGE, OVERLAP = 800, 100
#: Bound on training documents of each class; they are those lowest by a hash of doc_id.
TRAIN_PER_CLASS = 1200
#: Bound on the characters of all training documents together; those that would pass it are left out, in the order of the hash.
TRAIN_CHARACTERS = 60_000_000
THRESHOLD = 0.5
SMOOTHING, L2 = 1.0, 1e-5
EPOCHS = (4, 12)  # of the first round and of the others

_last: dict[str, np.ndarray] = {}


def plain(text: str) -> np.ndarray:
    """Code points of the lower-cased text, other characters than those of words as single spaces, spaces around."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_table()[points]
    points = np.where(inside, points, np.uint32(32))
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first of a run of others stays as the space
    if len(keep) and not inside[0]:
        keep[0] = False
    return np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)] if len(points) and inside[-1] else np.zeros(0, np.int32)))


def features(points: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams by the index of their first character, for each size."""
    p = points.astype(np.uint64)
    h = p * np.uint64(0xC2B2AE3D27D4EB4F)
    found = []
    for n in range(2, max(SIZES) + 1):
        if len(p) < n:
            break
        h = (h[: len(p) - n + 1] + p[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            found.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
    return found


def passages(text: str | None) -> list[np.ndarray]:
    """Distinct features of each passage of the whole text."""
    points = plain(text or "")
    if len(points) <= 2:
        return []
    if "last" not in _last:
        _last["last"] = np.zeros(1 << BITS, np.int32)
    last = _last["last"]
    found = features(points)
    rows = []
    for s in range(0, max(1, len(points) - OVERLAP), PASSAGE - OVERLAP):
        ids = np.concatenate([h[s : s + PASSAGE - n + 1] for h, n in zip(found, SIZES, strict=False)]) if found else np.zeros(0, np.int32)
        place = np.arange(len(ids), dtype=np.int32)
        last[ids] = place
        rows.append(ids[last[ids] == place])  # each feature once, without sorting
    return rows


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weight: np.ndarray  # log-count ratio times fitted coefficient
    ratio: np.ndarray
    bias: float

    def score_features(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        ids = np.concatenate(rows)
        ends = np.cumsum([len(r) for r in rows])
        starts = np.concatenate(([0], ends[:-1]))
        if not len(ids):
            return np.full(len(rows), 0.0)
        total = lambda x: np.where(ends > starts, np.add.reduceat(x, np.minimum(starts, len(ids) - 1)), 0.0)
        norm = np.sqrt(total(self.ratio[ids] ** 2))
        return _sigmoid(total(self.weight[ids]) / np.maximum(norm, 1e-9) + self.bias)

    def score(self, text: str | None) -> float:
        rows = passages(text)
        return float(self.score_features(rows).max()) if rows else 0.0


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int) -> Model:
    """Log-count ratios of distinct features, then logistic regression by Adagrad on unit-length scaled rows."""
    dims = 1 << BITS
    p, q = np.full(dims, SMOOTHING), np.full(dims, SMOOTHING)
    for row, y in zip(rows, toxic, strict=True):
        (p if y else q)[row] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    ratio[(p + q) <= 2 * SMOOTHING + 1] = 0.0  # a feature of one document says nothing
    w, squares = np.zeros(dims, np.float32), np.full(dims, 1e-6, np.float32)
    bias, bias_squares = 0.0, 1e-6
    scaled = [ratio[r] / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(toxic)
    random = np.random.default_rng(7)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for k in range(0, len(order), 32):
            pick = order[k : k + 32]
            ids, x = np.concatenate([rows[i] for i in pick]), np.concatenate([scaled[i] for i in pick])
            lengths = [len(rows[i]) for i in pick]
            owner = np.repeat(np.arange(len(pick)), lengths)
            error = (_sigmoid(np.bincount(owner, x * w[ids], len(pick)) + bias) - toxic[pick]) * share[pick] / len(pick)
            full = np.bincount(ids, x * error[owner], dims).astype(np.float32)
            each = np.flatnonzero(full)
            g = full[each] + L2 * w[each]
            squares[each] += g * g
            w[each] -= 0.5 * g / np.sqrt(squares[each])
            bias_squares += float(error.sum()) ** 2
            bias -= 0.5 * float(error.sum()) / np.sqrt(bias_squares)
    return Model(w * ratio, ratio, float(bias))


def train(labelled: list[tuple[str | None, int]]) -> Model:
    """Fit on (text, toxic) pairs."""
    toxic = np.array([bool(y) for _, y in labelled])
    if not toxic.any() or toxic.all():
        raise ValueError("the labels need toxic and clean documents")
    parts = [passages(text) for text, _ in labelled]
    model = fit([np.unique(np.concatenate(p)) if p else np.zeros(0, np.int32) for p in parts], toxic, EPOCHS[0])
    for _ in range(2):
        best = [p[int(np.argmax(model.score_features(p)))] if p else np.zeros(0, np.int32) for p in parts]
        model = fit(best, toxic, EPOCHS[1])
    return model


def train_on(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled documents: the per_class lowest of each class by hash of doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 0").orderBy(*order).limit(per_class).unionByName(known.where("toxic <> 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class rows of two numbers
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    total = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy().orderBy(*order))  # over at most 2 * per_class rows
    rows = texts.withColumn("total", total).where(F.col("total") <= TRAIN_CHARACTERS).select("doc_id", "toxic", "text").collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def toxicity_score(model: Model):
    """A pandas UDF from text to score; the model (2 MB) goes with it."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    if docs.isEmpty():  # nothing to learn from, and nothing to score
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("toxic"))
    score = toxicity_score(train_on(docs, labels, per_class))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("toxic"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The documents that are not toxic, whole rows."""
    if docs.isEmpty():
        return docs
    score = toxicity_score(train_on(docs, labels, per_class))
    return docs.where(score(docs["text"]) < threshold)
