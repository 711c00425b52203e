"""Full-text search: BM25 top-k, the match grammar, snippets and identifier cross-references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, plain_tokens
from . import query as Q

K1, B = 1.2, 0.75
MIN_IDF = 1e-6


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def occurrences(low: Column, term: str) -> Column:
    """Occurrences of a term as a whole token of a lower-cased text; no array of tokens is built."""
    return F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])")).cast("bigint")


def has_phrase(tokens: Column, words: list[str]) -> Column:
    """Whether the words occur one after another."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def near(tokens: Column, first: str, second: str, gap: int = 10) -> Column:
    """Whether two terms occur with at most ``gap`` tokens between."""
    at = lambda word: F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())
    return F.exists(at(first), lambda i: F.exists(at(second), lambda j: F.abs(i - j) <= gap + 1))


def _matches(leaf: Q.Leaf, tokens: Column, columns: dict[str, str]) -> Column:
    source = plain_tokens(F.col(columns.get(leaf.column, leaf.column))) if leaf.column else tokens
    if leaf.kind == "near":
        hit = F.array_contains(source, leaf.words[0])
        for x, y in zip(leaf.words, leaf.words[1:], strict=False):
            hit = hit & near(source, x, y, leaf.gap)
    elif leaf.kind == "prefix":
        hit = F.contains(F.concat(F.lit(" "), F.array_join(source, " "), F.lit(" ")), F.lit(f" {' '.join(leaf.words)}"))
    elif leaf.kind == "phrase":
        hit = has_phrase(source, list(leaf.words))
    else:
        hit = F.array_contains(source, leaf.words[0])
    return F.coalesce(hit, F.lit(False))


def match(docs: DataFrame, query: str, text_column: str = "text", columns: dict[str, str] | None = None) -> DataFrame:
    """The documents that a query matches, without an index; a blank query matches none."""
    expression = Q.parse(query)
    if expression is None:
        return docs.where(F.lit(False))
    tokens = plain_tokens(F.col(text_column))
    return docs.where(Q.condition(expression, lambda leaf: _matches(leaf, tokens, columns or {})))


def bm25(docs: DataFrame, terms: list[str], keep: Column | None = None, limit: int = 25, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of the best documents that hold every term, lowest score first.

    One scan yields length and frequencies of the terms; only corpus totals are
    aggregated, so nothing but those few numbers is exchanged before the top-k.
    ``keep`` filters results, not the corpus that the statistics describe.
    """
    terms = list(dict.fromkeys(word for t in terms for word in re.findall("[a-z0-9]+", t.lower())))
    kept = F.lit(True) if keep is None else keep
    low = F.lower(F.col(text_column))
    counted = docs.select(
        F.col(id_column).alias("doc_id"), kept.alias("kept"), F.regexp_count(low, F.lit("[a-z0-9]+")).cast("bigint").alias("len"), *[occurrences(low, t).alias(f"f{i}") for i, t in enumerate(terms)]
    )
    totals = counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(terms))]
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
        f = F.col(f"f{i}").cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    every = F.col("kept")
    for i in range(len(terms)):
        every = every & (F.col(f"f{i}") > 0)
    hits = counted.where(every).crossJoin(F.broadcast(totals))  # totals is one row
    return hits.select("doc_id", score.alias("score")).orderBy("score", "doc_id").limit(clamp(limit, 100))


def snippet(docs: DataFrame, terms: list[str], window: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, snippet): the window of tokens with most hits, hits in brackets, cut ends marked."""
    wanted = frozenset(t.lower() for t in terms)

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            spans = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text)]
            hits = [text[a:b].lower() in wanted for a, b in spans]
            if not any(hits):
                return ""
            running, top, at = sum(hits[:window]), -1, 0
            for i in range(max(1, len(spans) - window + 1)):
                if i:
                    running += (hits[i + window - 1] if i + window - 1 < len(hits) else 0) - hits[i - 1]
                if running > top:
                    top, at = running, i
            last = min(len(spans), at + window) - 1
            out, pos = [], spans[at][0]
            for j in range(at, last + 1):
                a, b = spans[j]
                out += [text[pos:a], f"[{text[a:b]}]" if hits[j] else text[a:b]]
                pos = b
            return ("… " if at else "") + "".join(out) + (" …" if last < len(spans) - 1 else "")

        return texts.map(one, na_action="ignore")

    return docs.select(F.col(id_column).alias("doc_id"), best(F.col(text_column)).alias("snippet")).where("snippet <> ''")


def xref_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(term, doc_id) of identifiers."""
    return docs.select(F.explode(identifiers(F.col(text_column))).alias("term"), F.col(id_column).alias("doc_id"))


def xref_lookup(docs: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """(language, n_documents, doc_ids): where an identifier occurs, by language; at most 500 rows are looked up."""
    hits = docs.where(F.array_contains(identifiers(F.col("text")), term)).select("lang", "doc_id").orderBy("lang", "doc_id").limit(clamp(limit, 500))
    return hits.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n_documents"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def related(docs: DataFrame, terms_each: int = 6, rows_a_term: int = 10, most: int = 10) -> DataFrame:
    """(doc_id, related_id, place): documents that share one of the first identifiers of a document.

    A document offers its first ``terms_each`` identifiers; of each, the first ``rows_a_term`` other documents count,
    and of those the first ``most``.
    """
    ids = docs.select("doc_id", identifiers(F.col("text")).alias("ids"))
    index = ids.select(F.explode("ids").alias("term"), F.col("doc_id").alias("related_id"))
    ranked = index.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("related_id"))).where(F.col("r") <= rows_a_term + 1)
    own = ids.select("doc_id", F.posexplode(F.slice("ids", 1, terms_each)).alias("t", "term"))
    pairs = own.join(ranked, "term").where("doc_id <> related_id")
    pairs = pairs.withColumn("r2", F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("related_id"))).where(F.col("r2") <= rows_a_term)
    first = pairs.groupBy("doc_id", "related_id").agg(F.min(F.struct("t", "r2")).alias("at"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "related_id"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "related_id", F.col("place").cast("bigint").alias("place"))
