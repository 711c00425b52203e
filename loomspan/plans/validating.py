"""Validation queries: each document's Markdown is a bundle of its own, each source a bundle of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import validation as V
from ..registry import register
from ..sources.tables import table
from .markdown import _LINES, MD_SQL, markdown_documents

_SECTIONS = ["## Documentation", "### Topic", "[next]"]


@register(
    "validation_output_issues",
    f"""WITH {MD_SQL} SELECT doc_id, code, count(*) AS n FROM (
      SELECT doc_id, 'tiny_output' AS code FROM md WHERE length(text) < 2000 UNION ALL SELECT doc_id, 'code_fence' FROM md WHERE len(regexp_extract_all(text, '```')) % 2 = 1
      UNION ALL SELECT doc_id, 'missing_section' FROM md WHERE NOT contains(text, '## Documentation')) GROUP BY ALL""",
)
def validation_output_issues(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir).withColumns({"documents": F.lit(1), "topics": F.lit(1)})
    return V.output_issues(docs, "doc_id", "text", _SECTIONS).groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))


def _bundles(spark, sf_dir):
    """Each Markdown document as a bundle; every 13th has no output, the counts differ in some."""
    k = F.col("doc_id")
    text = F.when(k % 13 != 0, F.concat(F.col("text"), F.when(k % 3 == 0, F.lit("## Documentation\n#### Early\n### Topic 1\n#### Entry\n#### Entry\n### Topic 1\n")).otherwise(F.lit("## Metadata\n## Documentation\n### Topic 2\n#### Entry\n"))))
    topics = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Topic "), (k % 2 + 1).cast("string"))))
    return markdown_documents(spark, sf_dir).select(
        "doc_id", "source", text.alias("text"), topics.alias("topics"), (k % 4).alias("documents"), (k % 3).alias("topic_documents"), (k % 6).alias("discovered"), F.when(k % 7 != 0, k % 5).alias("emitted"), (k % 2).alias("skipped"),
    )


def _files(spark, sf_dir):
    """Documents as files of a bundle a source, a folder a language, and a section page for each folder."""
    k, s = F.col("doc_id"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null and lang is not null")
    text = s("# Document ", k, "\n", '<a id="Part-', k % 3, '"></a>\n', "[own](#document", k, ") [part](#part-", k % 4, ") [next](", k + 5, ".md#part-", k % 2, ") [up](../", F.col("lang"), "/", k, ".md) [out](../../x.md) ![pic](none.png) [web](https://example.com)\n")
    files = docs.select(F.col("source").alias("bundle"), s(F.col("lang"), "/", k, ".md").alias("path"), text.alias("text"))
    listed = docs.where(k % 10 == 0).select(F.col("source").alias("bundle"), "lang", F.explode(F.array(*[s("[", k, "](", k + i, ".md) ") for i in (0, 0, 1)])).alias("link"))
    sections = listed.groupBy("bundle", "lang").agg(F.array_join(F.collect_list("link"), "").alias("text")).select("bundle", s(F.col("lang"), "/_section.md").alias("path"), "text")
    return files.unionByName(sections)


_WEIGHT = "CASE code " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, (_, w, _) in V.RULES.items()) + " END"


def _sum(part: str) -> str:
    codes = ", ".join(f"'{c}'" for c, (_, _, p) in V.RULES.items() if p == part)
    return f"coalesce(sum({_WEIGHT}) FILTER (code IN ({codes})), 0)"


_BUNDLES = f"""WITH {MD_SQL},
b AS (SELECT doc_id, source, CASE WHEN doc_id % 13 <> 0 THEN text || CASE WHEN doc_id % 3 = 0 THEN '## Documentation' || chr(10) || '#### Early' || chr(10) || '### Topic 1' || chr(10) || '#### Entry' || chr(10) || '#### Entry' || chr(10) || '### Topic 1' || chr(10)
    ELSE '## Metadata' || chr(10) || '## Documentation' || chr(10) || '### Topic 2' || chr(10) || '#### Entry' || chr(10) END END AS text,
  CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['Topic ' || (doc_id % 2 + 1)] END AS topics, doc_id % 4 AS documents, doc_id % 3 AS topic_documents, doc_id % 6 AS discovered, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 END AS emitted, doc_id % 2 AS skipped FROM md),
"""
_BUNDLE_ISSUES = _BUNDLES + _LINES[_LINES.index("raw AS"):].replace("FROM md)", "FROM b WHERE text IS NOT NULL)", 1) + """,
tabs AS (SELECT *, contains(line, '|') AS is_row, sum(CASE WHEN contains(line, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM prose),
own AS (SELECT doc_id, unnest(regexp_extract_all(text, '<a\\s+id="([^"]+)"\\s*></a>', 1)) AS anchor FROM b),
body AS (SELECT *, substr(text, instr(text, '## Documentation')) AS body FROM b WHERE contains(text, '## Documentation')),
h AS (SELECT doc_id, documents, topics, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM (SELECT *, regexp_extract_all(body, '(?m)^#{3,4}[ \\t]+\\S.*$') AS a FROM body)),
hh AS (SELECT *, CASE WHEN starts_with(line, '####') THEN 4 ELSE 3 END AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM h),
carried AS (SELECT *, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS topic FROM hh),
issues AS (
  SELECT doc_id, 'missing_output' AS code FROM b WHERE text IS NULL
  UNION ALL SELECT doc_id, 'no_documents' FROM b WHERE text IS NOT NULL AND documents = 0
  UNION ALL SELECT doc_id, 'tiny_output' FROM b WHERE length(text) < 2000
  UNION ALL SELECT doc_id, 'code_fence' FROM b WHERE len(regexp_extract_all(text, '```')) % 2 = 1
  UNION ALL SELECT doc_id, 'missing_section' FROM b, (SELECT unnest(['## Metadata', '## Table of Contents', '## Documentation']) AS s) WHERE NOT contains(text, s)
  UNION ALL SELECT doc_id, 'no_topics' FROM b WHERE text IS NOT NULL AND len(topics) = 0
  UNION ALL SELECT DISTINCT doc_id, code FROM (SELECT doc_id, CASE WHEN trim(target) = '' THEN 'empty_link_target'
      WHEN regexp_matches(trim(target), '^(https?://|mailto:|tel:|data:|dash://|#)') OR regexp_matches(trim(target), '^[[:alpha:]][+.0-9A-Za-z-]*:') THEN NULL
      WHEN image THEN 'relative_image' ELSE 'relative_link' END AS code FROM links) WHERE code IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 'missing_internal_anchor' FROM links l WHERE NOT image AND starts_with(trim(target), '#') AND trim(target) <> '#' AND NOT EXISTS (SELECT 1 FROM own a WHERE a.doc_id = l.doc_id AND a.anchor = substr(trim(target), 2))
  UNION ALL SELECT doc_id, 'duplicate_topic_section' FROM (SELECT doc_id, unnest(topics) AS t FROM body) JOIN hh USING (doc_id) WHERE level = 3 AND title = t GROUP BY doc_id, t HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'document_heading_count_mismatch' FROM hh GROUP BY doc_id, documents HAVING documents > 0 AND count(*) FILTER (level = 4) <> documents
  UNION ALL SELECT doc_id, 'malformed_heading_hierarchy' FROM hh GROUP BY doc_id HAVING min_by(level, pos) = 4
  UNION ALL SELECT DISTINCT doc_id, 'duplicate_document_heading' FROM (SELECT doc_id FROM carried WHERE level = 4 AND topic IS NOT NULL GROUP BY doc_id, topic, title HAVING count(*) > 1)
  UNION ALL SELECT doc_id, 'topic_total_mismatch' FROM b WHERE text IS NOT NULL AND emitted IS NOT NULL AND topic_documents <> documents
  UNION ALL SELECT doc_id, 'source_inventory_mismatch' FROM b WHERE text IS NOT NULL AND discovered > 0 AND emitted + skipped < discovered
  UNION ALL SELECT doc_id, 'emitted_less_than_compiled' FROM b WHERE text IS NOT NULL AND emitted < documents
  UNION ALL SELECT DISTINCT doc_id, 'html_artifact' FROM prose WHERE regexp_matches(line, '(?i)</?(li|ol|ul|p|th|td|tr|table|aside|nav|article|section|span|div)\\b')
  UNION ALL SELECT DISTINCT doc_id, 'definition_list_artifact' FROM prose WHERE regexp_matches(line, '^\\s*:\\s+\\S')
  UNION ALL SELECT DISTINCT doc_id, 'malformed_table' FROM (SELECT doc_id FROM tabs WHERE is_row GROUP BY doc_id, island HAVING count(*) >= 2 AND count(DISTINCT length(line) - length(replace(line, '|', ''))) > 1 AND bool_or(contains(line, '---'))))"""
_FILES = """WITH d AS (SELECT doc_id AS k, source AS bundle, lang FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
found AS (
  SELECT bundle, lang || '/' || k || '.md' AS path, 'relative_link' AS code FROM d
  UNION ALL SELECT bundle, lang || '/' || k || '.md', 'relative_image' FROM d
  UNION ALL SELECT bundle, lang || '/' || k || '.md', 'broken_internal_link' FROM d WHERE k % 4 <> k % 3
  UNION ALL SELECT a.bundle, a.lang || '/' || a.k || '.md', 'broken_internal_link' FROM d a LEFT JOIN d b ON b.bundle = a.bundle AND b.lang = a.lang AND b.k = a.k + 5 WHERE b.k IS NULL OR b.k % 3 <> a.k % 2
  UNION ALL SELECT bundle, lang || '/' || k || '.md', 'broken_internal_link' FROM d
  UNION ALL SELECT bundle, lang || '/' || k || '.md', 'duplicate_section_link' FROM d WHERE k % 10 = 0)
"""


@register("validation_issues", _BUNDLE_ISSUES + " SELECT doc_id, CASE WHEN code IN ('missing_output', 'no_documents', 'tiny_output') THEN 'error' ELSE 'warning' END AS level, code FROM issues")
def validation_issues(spark, sf_dir):
    return V.bundle_issues(_bundles(spark, sf_dir), "doc_id")


@register("validation_document_issues", _FILES + "SELECT bundle, path, 'warning' AS level, code FROM found")
def validation_document_issues(spark, sf_dir):
    return V.document_issues(_files(spark, sf_dir))


_COMPONENTS_SQL = ", ".join(f"{_sum(p)} AS {p}" for p in ("completeness", "structure", "conversion", "consistency"))
_clip = "CAST(round(greatest(0, least(1, 1 - {} / {})), 2) AS DOUBLE)".format


@register(
    "validation_scores",
    _BUNDLE_ISSUES + f""", n AS (SELECT source, CAST(sum(documents) AS BIGINT) AS documents, count(DISTINCT lang) AS topics FROM (SELECT b.source, b.documents, md.lang FROM b JOIN md USING (doc_id)) WHERE source IS NOT NULL GROUP BY source),
    w AS (SELECT source, {_COMPONENTS_SQL} FROM issues JOIN b USING (doc_id) GROUP BY source),
    q AS ({_FILES} SELECT bundle AS source, sum({_WEIGHT.replace("END", "ELSE 0.25::DOUBLE END")}) AS weight FROM found GROUP BY bundle),
    s AS (SELECT n.source, coalesce(completeness, 0) AS completeness, coalesce(structure, 0) AS structure, coalesce(conversion, 0) AS conversion, coalesce(consistency, 0) AS consistency, coalesce(weight, 0) AS quality,
      1 + least(1.6, sqrt(greatest(documents - 1, 0)) * 0.18 + sqrt(greatest(topics - 1, 0)) * 0.08) AS scale, 1 + least(1.8, sqrt(greatest(documents - 1, 0)) * 0.22) AS doc_scale FROM n LEFT JOIN w USING (source) LEFT JOIN q USING (source)),
    r AS (SELECT source, {_clip("completeness", "scale")} AS completeness, {_clip("structure", "greatest(1.0, scale * 0.95)")} AS structure, {_clip("conversion", "(scale * 1.1)")} AS conversion, {_clip("consistency", "scale")} AS consistency, {_clip("quality", "doc_scale")} AS document_quality FROM s)
    SELECT *, completeness * 0.35 + structure * 0.25 + conversion * 0.15 + consistency * 0.15 + document_quality * 0.10 AS score FROM r""",
)
def validation_scores(spark, sf_dir):
    bundles = _bundles(spark, sf_dir)
    lang = markdown_documents(spark, sf_dir).select("doc_id", "lang")
    of_bundles = V.bundle_issues(bundles.select(F.struct("doc_id", "source").alias("key"), *[c for c in bundles.columns if c not in ("doc_id", "source")]), "key").select("key.source", F.lit("bundle").alias("scope"), "level", "code")
    of_documents = V.document_issues(_files(spark, sf_dir)).select(F.col("bundle").alias("source"), F.lit("document").alias("scope"), "level", "code")
    sizes = bundles.select("doc_id", "source", "documents").join(lang, "doc_id").where("source is not null").groupBy("source").agg(F.sum("documents").alias("documents"), F.count_distinct("lang").alias("topics"))
    return V.component_scores(of_bundles.unionByName(of_documents), sizes, "source")


@register("validation_document_quality", _FILES + "SELECT bundle, path, count(*) AS n_issues, round(greatest(0, 1 - least(0.95, count(*) * 0.12)), 2) AS quality FROM found GROUP BY bundle, path")
def validation_document_quality(spark, sf_dir):
    return V.document_quality(V.document_issues(_files(spark, sf_dir)), "bundle", "path")


@register(
    "validation_inventory",
    """WITH l AS (SELECT source, count(*) AS documents, count(quality) AS emitted, count(*) FILTER (toxic = 1) AS skipped, count(*) + 3 AS discovered, count(*) - (length(source) % 2) AS topic_documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, 'topic_total_mismatch' AS code FROM l WHERE topic_documents <> documents UNION ALL SELECT source, 'source_inventory_mismatch' FROM l WHERE emitted + skipped < discovered
    UNION ALL SELECT source, 'emitted_less_than_compiled' FROM l WHERE emitted < documents""",
)
def validation_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("quality").alias("emitted"), F.count_if(F.col("toxic") == 1).alias("skipped"),
        (F.count(F.lit(1)) + 3).alias("discovered"), (F.count(F.lit(1)) - F.length(F.first("source")) % 2).alias("topic_documents"),
    )
    return V.inventory_issues(rows, "source")


@register("validation_rates", "SELECT source, round(count(quality) / count(*), 4) AS success_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def validation_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    return rows.agg(I.rate(F.count("quality"), F.count(F.lit(1))).alias("success_rate"))
