"""Markdown queries.

documents hold plain prose, so a Markdown text is built around each one, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import markdown as M
from ..registry import register
from ..sources.tables import table

MD_SQL = """md AS (SELECT doc_id, source, lang,
  '# ' || source || ' ' || doc_id || chr(10) || chr(10) || replace(text, '|', '/') || chr(10) || '### Topic ' || (doc_id % 5) || chr(10) || '#### Entry ' || (doc_id % 3) || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '#### Entry ' || (doc_id % 3) || '  ' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '# [in code](../code.md)' || chr(10) || '```' || chr(10) ELSE '' END
  || '[next](#anchor-' || (doc_id % 7) || ') and `[span](x.md)` then [rel](../a/' || doc_id || '.md#top) ![pic](img/' || (doc_id % 4) || '.png) [gone]() [ok](https://example.com/' || doc_id || ')' || chr(10)
  || '<a id="anchor-' || (doc_id % 5) || '"></a>' || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| only |' || chr(10) ELSE '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) END
  || CASE WHEN doc_id % 6 = 0 THEN '<div>left</div>' || chr(10) || ': defined' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN '```' || chr(10) || 'open' || chr(10) ELSE '' END AS text
  FROM documents)"""


def markdown_documents(spark, sf_dir):
    """(doc_id, source, lang, text) with headings, fences, links, anchors and tables around the text of a document."""
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = lambda m, *parts: F.when(k % m == 0, s(*parts)).otherwise(F.lit(""))
    table_end = F.when(k % 4 == 0, F.lit("| only |\n")).otherwise(F.lit("| 1 | 2 |\n"))
    text = F.concat(
        s("# ", F.col("source"), " ", k, "\n\n", F.translate("text", "|", "/"), "\n### Topic ", k % 5, "\n#### Entry ", k % 3, "\n"),
        when(2, "#### Entry ", k % 3, "  \n"),
        when(3, "```\n# [in code](../code.md)\n```\n"),
        s("[next](#anchor-", k % 7, ") and `[span](x.md)` then [rel](../a/", k, ".md#top) ![pic](img/", k % 4, ".png) [gone]() [ok](https://example.com/", k, ")\n"),
        s('<a id="anchor-', k % 5, '"></a>\n'),
        s("| a | b |\n| --- | --- |\n", table_end),
        when(6, "<div>left</div>\n: defined\n"),
        when(11, "```\nopen\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("text"))


_LINES = f"""WITH {MD_SQL},
raw AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM md),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM raw),
f AS (SELECT *, starts_with(ltrim(line), '```') AS is_fence, sum(CAST(starts_with(ltrim(line), '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS opened FROM l),
prose AS (SELECT doc_id, line_no, line FROM f WHERE NOT is_fence AND opened % 2 = 0),
seg AS (SELECT doc_id, line_no, unnest(string_split(line, '`')) AS segment, generate_subscripts(string_split(line, '`'), 1) - 1 AS segment_no FROM prose),
links AS (
  SELECT doc_id, line_no, segment_no, generate_subscripts(m, 1) - 1 AS n, regexp_extract(unnest(m), '(!?)\\[([^\\]]*)\\]\\(([^)]*)\\)', 1) = '!' AS image,
    regexp_extract(unnest(m), '(!?)\\[([^\\]]*)\\]\\(([^)]*)\\)', 2) AS label, regexp_extract(unnest(m), '(!?)\\[([^\\]]*)\\]\\(([^)]*)\\)', 3) AS target
  FROM (SELECT *, regexp_extract_all(segment, '!?\\[[^\\]]*\\]\\([^)]*\\)') AS m FROM seg WHERE segment_no % 2 = 0))"""

_HEADINGS = f"""WITH {MD_SQL},
h AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (
  SELECT doc_id, regexp_extract_all(text, '(?m)^(#{{1,6}})[ \\t]+(\\S(?:.*\\S)?)[ \\t]*$') AS a FROM md)),
hh AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#+[ \\t]+(.*?)[ \\t]*$', 1) AS title FROM h)"""


def _on_md(name: str, sql: str, run) -> None:
    @register(name, sql)
    def query(spark, sf_dir):
        return run(markdown_documents(spark, sf_dir))


_on_md("markdown_headings", _HEADINGS + " SELECT doc_id, pos, level, title FROM hh", M.headings)
_on_md("markdown_fence_state", _LINES + " SELECT doc_id, line_no, is_fence, opened % 2 = 1 AND NOT is_fence AS in_code FROM f",
       lambda d: M.with_fences(d).select("doc_id", "line_no", "is_fence", "in_code"))
_on_md("markdown_links", _LINES + " SELECT doc_id, line_no, segment_no, n, image, label, target FROM links", M.links)
_on_md("markdown_anchors", f"WITH {MD_SQL} SELECT doc_id, unnest(regexp_extract_all(text, '<a\\s+id=\"([^\"]+)\"\\s*></a>', 1)) AS anchor FROM md", M.anchors)
_on_md(
    "markdown_broken_anchors",
    _LINES + """, a AS (SELECT doc_id, unnest(regexp_extract_all(text, '<a\\s+id="([^"]+)"\\s*></a>', 1)) AS anchor FROM md)
    SELECT doc_id, substr(target, 2) AS anchor FROM links l WHERE starts_with(target, '#') AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = l.doc_id AND a.anchor = substr(target, 2))""",
    M.broken_anchors,
)
_on_md(
    "markdown_link_problems",
    _LINES + """ SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, CASE WHEN trim(target) = '' THEN 'empty_link_target'
      WHEN regexp_matches(trim(target), '^(https?://|mailto:|tel:|data:|dash://|#)') OR regexp_matches(trim(target), '^[[:alpha:]][+.0-9A-Za-z-]*:') THEN NULL
      WHEN image THEN 'relative_image' ELSE 'relative_link' END AS code FROM links) WHERE code IS NOT NULL GROUP BY ALL""",
    M.link_problems,
)
_on_md(
    "markdown_malformed_tables",
    _LINES + """, r AS (SELECT *, contains(line, '|') AS is_row, sum(CASE WHEN contains(line, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM prose)
    SELECT doc_id, min(line_no) AS first_line, count(*) AS n_lines FROM r WHERE is_row GROUP BY doc_id, island
    HAVING count(*) >= 2 AND count(DISTINCT length(line) - length(replace(line, '|', ''))) > 1 AND bool_or(contains(line, '---'))""",
    M.malformed_tables,
)
_on_md(
    "markdown_artefacts",
    _LINES + """ SELECT doc_id, code, count(*) AS n FROM (
      SELECT doc_id, 'html_artifact' AS code FROM prose WHERE regexp_matches(line, '(?i)</?(li|ol|ul|p|th|td|tr|table|aside|nav|article|section|span|div)\\b')
      UNION ALL SELECT doc_id, 'definition_list_artifact' FROM prose WHERE regexp_matches(line, '^\\s*:\\s+\\S')) GROUP BY ALL""",
    M.artefacts,
)
_on_md(
    "markdown_duplicate_headings",
    _HEADINGS + """, c AS (SELECT *, coalesce(last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS topic FROM hh)
    SELECT doc_id, topic, title, count(*) AS n FROM c WHERE level = 4 GROUP BY ALL HAVING count(*) > 1""",
    M.duplicate_headings,
)
_on_md("markdown_heading_before_topic", _HEADINGS + " SELECT doc_id FROM hh WHERE level IN (3, 4) GROUP BY doc_id HAVING min_by(level, pos) = 4", M.heading_before_topic)
_on_md("markdown_odd_fences", f"WITH {MD_SQL} SELECT doc_id FROM md WHERE len(regexp_extract_all(text, '```')) % 2 = 1", M.odd_fences)
_on_md(
    "markdown_heading_anchors",
    _HEADINGS + " SELECT doc_id, pos, regexp_replace(lower(trim(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g'))), '\\s+', '-', 'g') AS anchor FROM hh",
    M.heading_anchors,
)
_on_md(
    "markdown_heading_shift",
    f"""WITH {MD_SQL}, s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#####(\\s)', '######\\1', 'g'), '(?m)^(#{{1,4}})(\\s)', '\\1##\\2', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM md)
    SELECT doc_id, sha256(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS sha FROM s""",
    lambda d: d.select("doc_id", F.sha2(T.shift_headings(F.col("text")), 256).alias("sha")),
)
_on_md(
    "markdown_quality_text",
    f"WITH {MD_SQL} SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS sha FROM md",
    lambda d: d.select("doc_id", F.sha2(T.markdown_quality(F.col("text")), 256).alias("sha")),
)
