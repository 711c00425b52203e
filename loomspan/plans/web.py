"""Web page queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..operators import adapters as A
from ..registry import register
from ..sources.tables import table

_TRACKED = ", ".join(f"'{t}'" for t in sorted(U.TRACKING))
_NORMAL = f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^http://', 'https://') AS bare FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(split_part(bare, '?', 1), '/(index\\.html?|index\\.md|README\\.md|readme\\.md)$', ''), '/+$', '') AS p,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACKED}))), '&') AS q FROM a),
c AS (SELECT page_id, regexp_extract(p, '^(https://[^/]*)', 1) AS host, p, q FROM b),
n AS (SELECT page_id, lower(host) || CASE WHEN p = host THEN '/' ELSE substr(p, length(host) + 1) END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM c)"""


@register("url_normalize", _NORMAL + " SELECT page_id, url FROM n")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise_url(F.col("url")).alias("url"))


@register("url_normalize_builtin", _NORMAL + " SELECT page_id, url FROM n")
def url_normalize_builtin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.simple_normal(F.col("url")).alias("url"))


@register("url_duplicates", _NORMAL + " SELECT url, count(*) AS pages, min(page_id) AS first_page FROM n GROUP BY url HAVING count(*) > 1")
def url_duplicates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", U.simple_normal(F.col("url")).alias("url"))
    return pages.groupBy("url").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@register("url_host_counts", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@register(
    "url_document_filter",
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
    SELECT page_id FROM p WHERE NOT regexp_matches(path, '\\.(png|jpe?g|gif|svg|webp|ico|css|js|map|json|xml|zip|tar|gz|tgz|7z)$') AND (regexp_matches(path, '\\.(html?|md|txt|pdf|docx)$') OR NOT ends_with(path, '/'))""",
)
def url_document_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(U.looks_like_document(F.col("url"))).select("page_id")


@register("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@register("html_links", "SELECT page_id, unnest(a) AS href, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS a FROM pages)")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


@register(
    "crawl_depth1",
    """WITH l AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(a) AS target, generate_subscripts(a, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS a FROM pages)),
    f AS (SELECT page_id, target, min(pos) AS pos FROM (SELECT page_id, target, pos FROM l UNION ALL SELECT page_id, url, 0 FROM pages) GROUP BY ALL)
    SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM f QUALIFY place <= 5""",
)
def crawl_depth1(spark, sf_dir):
    """Each page and its links in order, anywhere on the site, once each; at most five are fetched."""
    return A.crawl(table(spark, sf_dir, "pages"), "page_id", "url", "html", prefix=F.lit("/"), most=5)


@register("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", H.html_to_markdown(F.col("html"), F.col("url")).alias("m"))
    return rows.select("page_id", "m.selector", "m.markdown")


@register("html_sections")
def html_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.html_sections(F.col("html"), F.col("url"))).alias("pos", "s"))
    return rows.select("page_id", "pos", "s.title", "s.markdown")


@register("selector_hits", "SELECT CASE WHEN contains(html, '<main') THEN 'main' WHEN contains(html, '<article') THEN 'article' ELSE 'document' END AS selector, count(*) AS pages FROM pages GROUP BY 1")
def selector_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(H.html_to_markdown(F.col("html"), F.col("url")).alias("m"))
    return rows.groupBy(F.col("m.selector").alias("selector")).agg(F.count(F.lit(1)).alias("pages"))
