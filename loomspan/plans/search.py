"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as X
from ..operators import search as S
from ..registry import register
from ..sources.tables import table
from ..storage import shared_dir, version_of

_TOKENS = "WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents)"


def _bm25_sql(terms: list[str], where: str = "TRUE", limit: int = 25) -> str:
    f = ", ".join(f"len(list_filter(tokens, lambda t: t = '{t}')) AS f{i}" for i, t in enumerate(terms))
    n = ", ".join(f"CAST(count(*) FILTER (f{i} > 0) AS DOUBLE) AS n{i}" for i in range(len(terms)))
    score = " ".join(
        f"- (CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len))"
        for i in range(len(terms))
    )
    every = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{_TOKENS},
    c AS (SELECT doc_id, lang, source, CAST(len(tokens) AS DOUBLE) AS len, {f} FROM d),
    t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avg_len, {n} FROM c)
    SELECT doc_id, CAST(0.0 {score} AS DOUBLE) AS score FROM c, t WHERE {every} AND ({where}) ORDER BY score, doc_id LIMIT {limit}"""


def _index(spark, sf_dir, *parts: str) -> X.Index:
    """The stored index of the documents; what a query reads of it is written when it isn't there or the documents have changed."""
    docs = table(spark, sf_dir, "documents")
    attributes = tuple(c for c in ("source",) if c in docs.columns)
    folder = f"{shared_dir(spark)}/index-{version_of(spark, f'{sf_dir}/documents.parquet')}"
    lacking = tuple(p for p in parts if not X.is_written(spark, folder, p))
    if lacking:
        return X.write_index(docs.where("doc_id is not null and text is not null"), folder, attributes=attributes, parts=lacking)
    return X.Index(folder, attributes=attributes)


@register("search_bm25_topk", _bm25_sql(["the", "thing"]))
def search_bm25_topk(spark, sf_dir):
    return X.bm25(spark, _index(spark, sf_dir, "postings", "documents"), ["the", "thing"])


@register("search_bm25_scan", _bm25_sql(["the", "thing"]))
def search_bm25_scan(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), ["the", "thing"])


@register("search_bm25_rare_terms", _bm25_sql(["worthless", "clown"], limit=10))
def search_bm25_rare_terms(spark, sf_dir):
    return X.bm25(spark, _index(spark, sf_dir, "postings", "documents"), ["worthless", "clown"], limit=10)


@register("search_language_filter", _bm25_sql(["der"], "lang = 'de'"))
def search_language_filter(spark, sf_dir):
    return X.bm25(spark, _index(spark, sf_dir, "postings", "documents"), ["der"], keep=F.col("language") == "de")


def _match(name: str, query: str, where: str) -> None:
    @register(name, f"{_TOKENS} SELECT doc_id FROM d WHERE {where}")
    def run(spark, sf_dir):
        return X.match(spark, _index(spark, sf_dir, "postings", "documents"), query, columns={"topic": "source"})

    @register(f"{name}_scan", f"{_TOKENS} SELECT doc_id FROM d WHERE {where}")
    def scan(spark, sf_dir):
        return S.match(table(spark, sf_dir, "documents"), query, columns={"topic": "source"}).select("doc_id")


_has = "list_contains(tokens, '{}')".format
_match("search_boolean_and", "idiot clown", f"{_has('idiot')} AND {_has('clown')}")
_match("search_boolean_or", "scum OR moron", f"{_has('scum')} OR {_has('moron')}")
_match("search_boolean_not", "stupid NOT trash", f"{_has('stupid')} AND NOT {_has('trash')}")
_match("search_prefix", "worthl*", "len(list_filter(tokens, lambda t: starts_with(t, 'worthl'))) > 0")
_match("search_phrase", '"licensed under the apache"', "contains(' ' || array_to_string(tokens, ' ') || ' ', ' licensed under the apache ')")
_match("search_column", "topic:src3 licensed", f"source = 'src3' AND {_has('licensed')}")
_match("search_parentheses", "(scum OR moron) AND the NOT (trash OR idiot)", f"({_has('scum')} OR {_has('moron')}) AND {_has('the')} AND NOT ({_has('trash')} OR {_has('idiot')})")
_match("search_column_only", "topic:src1 OR worthl* NOT topic:src2", "source = 'src1' OR (len(list_filter(tokens, lambda t: starts_with(t, 'worthl'))) > 0 AND source <> 'src2')")
_match(
    "search_near", "NEAR(idiot the)",
    "len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = 'idiot' AND list_contains(tokens[greatest(1, i - 11):i + 11], 'the'))) > 0",
)


@register("search_blank", "SELECT doc_id FROM documents WHERE FALSE")
def search_blank(spark, sf_dir):
    return X.match(spark, _index(spark, sf_dir, "documents"), "   ")


@register("search_snippets")
def search_snippets(spark, sf_dir):
    return S.snippet(table(spark, sf_dir, "documents"), ["worthless", "clown"])


@register(
    "search_postings",
    """SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM (
         SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM (
           SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)) GROUP BY ALL""",
)
def search_postings(spark, sf_dir):
    return X.postings(table(spark, sf_dir, "documents")).select("term", "doc_id", "tf", "positions")


@register(
    "search_term_statistics",
    """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (
         SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
)
def search_term_statistics(spark, sf_dir):
    made = X.postings(table(spark, sf_dir, "documents"))
    return made.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# RE2's word edges and character classes are ASCII, Java's are not: an identifier counts where no letter, digit or sign of a word stands beside it, and that
# is spelled out here for every language.
_IDS = rf"list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*(?:[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]+[A-Za-z0-9_]*)+', ' ', 'g'), '\b([A-Z][0-9A-Za-z]+|[a-z]+_[_0-9a-z]+)\b', 1)), lambda x: length(x) >= 3)"


@register("xref_index", f"SELECT unnest({_IDS}) AS term, doc_id FROM documents")
def xref_index(spark, sf_dir):
    return S.xref_index(table(spark, sf_dir, "documents"))


@register(
    "xref_lookup",
    f"""SELECT lang AS language, count(*) AS n_documents, list(doc_id ORDER BY doc_id) AS doc_ids FROM (
        SELECT lang, doc_id FROM documents WHERE list_contains({_IDS}, 'Version') ORDER BY lang, doc_id LIMIT 100) GROUP BY lang""",
)
def xref_lookup(spark, sf_dir):
    return X.xref_lookup(spark, _index(spark, sf_dir, "identifiers"), "Version")


@register(
    "related_docs",
    rf"""WITH ids AS (
      SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*(?:[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]+[A-Za-z0-9_]*)+', ' ', 'g'), '\b([A-Z][0-9A-Za-z]+|[a-z]+_[_0-9a-z]+)\b', 1), lambda x: length(x) >= 3) AS raw
      FROM documents),
    firsts AS (SELECT doc_id, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS ids FROM ids),
    idx AS (SELECT doc_id AS related_id, unnest(ids) AS term FROM firsts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY related_id) AS r FROM idx QUALIFY r <= 11),
    own AS (SELECT doc_id, unnest(ids[1:6]) AS term, generate_subscripts(ids[1:6], 1) AS t FROM firsts),
    pairs AS (
      SELECT doc_id, t, related_id, row_number() OVER (PARTITION BY doc_id, t ORDER BY related_id) AS r2
      FROM own JOIN ranked USING (term) WHERE doc_id <> related_id QUALIFY r2 <= 10),
    best AS (SELECT doc_id, related_id, min(t * 1000 + r2) AS place_key FROM pairs GROUP BY ALL)
    SELECT doc_id, related_id, row_number() OVER (PARTITION BY doc_id ORDER BY place_key, related_id) AS place FROM best QUALIFY place <= 10""",
)
def related_docs(spark, sf_dir):
    return S.related(table(spark, sf_dir, "documents"))
