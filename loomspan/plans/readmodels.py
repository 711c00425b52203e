"""Adapter and read-model queries on tables that stand in for what sources and runs leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapters as A
from ..operators import readmodels as R
from ..registry import register
from ..sources.tables import table

_s = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])

_MEMBERS = """WITH m AS (SELECT doc_id AS k, 'content/files/en-us/' || CASE doc_id % 5 WHEN 0 THEN 'web/' || lang || '/' WHEN 1 THEN 'web/api/' WHEN 2 THEN 'glossary/' ELSE 'learn_web/' END
    || CASE WHEN doc_id % 20 < 5 AND doc_id < 40 THEN '' ELSE 'part_' || (doc_id % 3) || '/item_' || doc_id || '/' END || 'index.md' AS member, lang,
    '---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'title: "Title ' || doc_id || '"' || chr(10) END || 'slug: "s/' || doc_id || '"' || chr(10) || 'page-type: ' || CASE WHEN doc_id % 2 = 0 THEN 'guide' ELSE 'Reference' END || chr(10) || '---' || chr(10) || 'Body ' || doc_id AS content
    FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL),
  d AS (SELECT DISTINCT ON (member) * FROM m ORDER BY member, k),
  r AS (SELECT *, substr(member, instr(member, '/files/en-us/') + 13) AS relative FROM d),
  p AS (SELECT *, CASE WHEN starts_with(relative, 'web/') THEN 'web/' || split_part(relative, '/', 2) ELSE split_part(relative, '/', 1) END AS area FROM r)"""


def _members(spark, sf_dir):
    k = F.col("doc_id")
    folder = F.when(k % 5 == 0, _s("web/", F.col("lang"), "/")).when(k % 5 == 1, F.lit("web/api/")).when(k % 5 == 2, F.lit("glossary/")).otherwise(F.lit("learn_web/"))
    inner = F.when((k % 20 < 5) & (k < 40), F.lit("")).otherwise(_s("part_", k % 3, "/item_", k, "/"))
    title = F.when(k % 3 == 0, F.lit("")).otherwise(_s('title: "Title ', k, '"\n'))
    content = F.concat(F.lit("---\n"), title, _s('slug: "s/', k, '"\n'), F.lit("page-type: "), F.when(k % 2 == 0, "guide").otherwise("Reference"), F.lit("\n---\n"), _s("Body ", k))
    rows = table(spark, sf_dir, "documents").where("doc_id is not null and lang is not null").select(F.concat(F.lit("content/files/en-us/"), folder, inner, F.lit("index.md")).alias("member"), content.alias("content"), k.alias("k"))
    return rows.groupBy("member").agg(F.min_by("content", "k").alias("content"))


@register("archive_area_index", _MEMBERS + " SELECT area, count(*) AS n_members, max(CASE WHEN relative = area || '/index.md' THEN member END) AS root_member FROM p GROUP BY area")
def archive_area_index(spark, sf_dir):
    return A.archive_index(_members(spark, sf_dir))


@register("archive_member_order", _MEMBERS + " SELECT area, member, row_number() OVER (PARTITION BY area ORDER BY member) - 1 AS order_hint FROM p")
def archive_member_order(spark, sf_dir):
    return A.archive_members(_members(spark, sf_dir))


@register(
    "archive_catalog",
    _MEMBERS + """, n AS (SELECT area, count(*) AS document_count FROM p GROUP BY area)
    SELECT CASE WHEN area = 'web/api' THEN 'web-apis' WHEN starts_with(area, 'web/') THEN substr(area, 5) ELSE replace(area, '_', '-') END AS slug,
      CASE WHEN k % 3 <> 0 THEN 'Title ' || k WHEN area = 'web/api' THEN 'Web APIs' WHEN area = 'learn_web' THEN 'Learn Web' ELSE upper(substr(regexp_extract(area, '([^/]*)$', 1), 1, 1)) || substr(regexp_extract(area, '([^/]*)$', 1), 2) END AS display_name,
      area, 's/' || k AS page_slug, CASE WHEN area = 'web/api' THEN ['api', 'web api'] ELSE [CASE WHEN starts_with(area, 'web/') THEN substr(area, 5) ELSE replace(area, '_', '-') END] END AS aliases,
      CASE WHEN area IN ('web/api', 'web/en') THEN 'supported' ELSE 'experimental' END AS support_level, document_count
    FROM p JOIN n USING (area) WHERE relative = area || '/index.md'""",
)
def archive_catalog(spark, sf_dir):
    return A.archive_catalog(_members(spark, sf_dir), ["web/api", "web/en"], {"web/api": ["api", "web api"]})


@register(
    "archive_documents",
    _MEMBERS + """, o AS (SELECT *, row_number() OVER (ORDER BY member) - 1 AS order_hint, relative <> 'learn_web/index.md' AS deep FROM p WHERE area = 'learn_web')
    SELECT member, order_hint, CASE WHEN deep THEN 'Part ' || regexp_extract(relative, 'part_(\\d)', 1) ELSE 'Reference' END AS topic, CASE WHEN deep THEN 'part-' || regexp_extract(relative, 'part_(\\d)', 1) || '-item-' || k ELSE 'index' END AS slug,
      CASE WHEN k % 3 <> 0 THEN 'Title ' || k WHEN deep THEN 'item ' || k ELSE '' END AS title, 's/' || k AS page_slug, 'Body ' || k AS markdown,
      CASE WHEN order_hint <= 2 THEN 'checkpoint_resume_skip' WHEN k % 2 = 0 THEN 'filtered_mode' END AS skip_reason, FALSE AS malformed_frontmatter FROM o""",
)
def archive_documents(spark, sf_dir):
    return A.archive_documents(_members(spark, sf_dir), "learn_web", ["reference"], "important", 2)


_ANCHORS = """WITH a AS (SELECT p_partkey, '<p><a class="x" href="/cheat_sheets/' || replace(p_brand, '#', '_') || '.docset/index.html">' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '<b>' || p_brand || '</b>  sheet' END || '</a> <a href="/other/' || p_partkey || '">no</a></p>' AS html FROM part)"""


@register(
    "anchor_catalog",
    """WITH f AS (SELECT replace(p_brand, '#', '_') AS slug, p_brand AS b FROM part GROUP BY p_brand)
    SELECT slug, b || ' sheet' AS display_name, '/cheat_sheets/' || slug || '.docset/index.html' AS homepage, [lower(b) || ' sheet', replace(slug, '_', ' ')] AS aliases FROM f""",
)
def anchor_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit('<p><a class="x" href="/cheat_sheets/'), F.regexp_replace("p_brand", "#", "_"), F.lit('.docset/index.html"><b>'), "p_brand", F.lit("</b>  sheet</a> <a href=\"/other/"), F.col("p_size").cast("string"), F.lit('">no</a></p>')).alias("html"))
    return A.anchor_catalog(rows)


@register(
    "catalog_enriched",
    """WITH c AS (SELECT DISTINCT p_brand AS slug FROM part), z AS (SELECT p_brand AS slug, max(CASE WHEN p_size > 40 THEN 0 ELSE p_size END) AS bytes FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand),
    q AS (SELECT p_brand AS slug, count(*) AS documents, count(*) FILTER (p_size > 20) / count(*) AS success FROM part GROUP BY p_brand)
    SELECT c.slug, CASE WHEN bytes > 0 THEN bytes END AS size_hint, CASE WHEN documents >= 200 AND success >= 0.9 THEN 'high' WHEN documents >= 50 AND success >= 0.7 THEN 'medium' WHEN documents > 0 THEN 'low' END AS confidence
    FROM c LEFT JOIN z USING (slug) LEFT JOIN q USING (slug)""",
)
def catalog_enriched(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sizes = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("slug"), F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size")).alias("bytes"), F.lit(None).cast("string").alias("last_modified"))
    stats = part.groupBy(F.col("p_brand").alias("slug")).agg(F.count(F.lit(1)).alias("documents"), (F.count_if(F.col("p_size") > 20) / F.count(F.lit(1))).alias("success"))
    return A.enriched(part.select(F.col("p_brand").alias("slug")).distinct(), sizes, stats).select("slug", "size_hint", "confidence")


@register("docset_quality_stats", "SELECT p_brand AS slug, count(*) AS indexed, count(*) FILTER (p_size > 10) AS emitted, round(count(*) FILTER (p_size > 10) / count(*), 4) AS success FROM part GROUP BY p_brand")
def docset_quality_stats(spark, sf_dir):
    return A.quality_stats(table(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), (F.col("p_size") > 10).alias("emitted")))


@register(
    "catalog_fallback",
    "SELECT source, count(*) AS n, bool_or(fallback) AS fallback FROM (SELECT p_type AS source, FALSE AS fallback FROM part WHERE p_type <> 'ECONOMY' UNION ALL SELECT p_type, TRUE FROM part WHERE p_type = 'ECONOMY') GROUP BY source",
)
def catalog_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("source"))
    return A.or_cached(rows.where("source <> 'ECONOMY'"), rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.bool_or("fallback").alias("fallback"))


@register(
    "catalog_refresh_status",
    """SELECT n_name AS source, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 4 = 0 THEN 'failed' WHEN n_nationkey % 5 = 0 THEN 'fallback' ELSE 'refreshed' END AS status,
      (n_nationkey % 2) + 1 AS supported, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS experimental, 1 AS ignored FROM nation""",
)
def catalog_refresh_status(spark, sf_dir):
    k = F.col("n_nationkey")
    levels = F.array(F.lit(""), F.when(k % 2 == 0, "experimental").otherwise("supported"), F.lit("ignored"))
    errors = F.when(k % 3 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    return A.refresh_status(table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), (k % 4).alias("entry_count"), errors.alias("errors"), (k % 5 == 0).alias("fallback_used"), levels.alias("support_levels")))


@register(
    "core_topic_lookup",
    """SELECT n_name AS slug, r_name AS family, CASE WHEN n_nationkey % 4 = 1 THEN ['n' || n_nationkey] WHEN r_regionkey % 2 = 0 THEN ['r' || r_regionkey] ELSE [] END AS core_topics
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def core_topic_lookup(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.array().cast("array<string>")
    topics = nation.where("n_nationkey % 2 = 1").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 1, F.array(_s("n", F.col("n_nationkey")))).otherwise(none).alias("topics")).unionByName(
        region.select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, F.array(_s("r", F.col("r_regionkey")))).otherwise(none).alias("topics")))
    entries = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("slug"), F.col("r_name").alias("family"))
    return A.core_topics(entries, topics)


@register(
    "docset_acceptance",
    """SELECT docset, path FROM (SELECT p_brand AS docset, CAST(p_partkey AS VARCHAR) || '.html#a' AS path, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name, CAST(p_partkey AS VARCHAR) || '.html#a') AS r FROM part)
    WHERE r <= 20 AND p_partkey % 4 = 0 QUALIFY row_number() OVER (PARTITION BY docset ORDER BY r) = 1""",
)
def docset_acceptance(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("docset"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), _s(F.col("p_partkey"), ".html#a").alias("path"))
    return A.accepted(rows, part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("docset"), _s(F.col("p_partkey"), ".html").alias("path")), 20)


@register(
    "probe_candidates",
    "SELECT slug, size FROM (SELECT p_name AS slug, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS size, p_partkey AS pos FROM part ORDER BY p_partkey LIMIT 64) WHERE size IS NULL OR size <= 30 ORDER BY size NULLS LAST, pos LIMIT 20",
)
def probe_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("size"), F.col("p_partkey").alias("pos"))
    return A.probe_candidates(rows, 30, 64, 20)


@register(
    "archive_validity",
    "SELECT n_name AS archive, r_name AS area, n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 AS valid FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def archive_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    stored = rows.select(F.col("n_name").alias("archive"), F.col("r_name").alias("area"), k.alias("size"), (k * 2).alias("mtime"), F.sha2("n_name", 256).alias("sha256"))
    found = rows.select(F.col("n_name").alias("archive"), F.when(k % 3 == 0, k + 1).otherwise(k).alias("size"), (k * 2).alias("mtime"), F.sha2("n_name", 256).alias("sha256"))
    return A.archive_valid(stored, found, stored.where("size % 2 = 0").select("archive", "area"))


@register("preset_categories", "SELECT n_name AS language, list(DISTINCT r_name ORDER BY r_name) AS categories FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey % 5 = r_regionkey WHERE r_regionkey <> 3 GROUP BY n_name")
def preset_categories(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey <> 3")
    by = lambda key: nation.select(F.upper("n_name").alias("request"), key.alias("r_regionkey"))
    rows = by(F.col("n_regionkey")).unionByName(by(F.col("n_nationkey") % 5)).join(region, "r_regionkey").select(F.col("r_name").alias("preset"), "request")
    return R.categories(nation.select(F.col("n_name").alias("language")), rows)


def _output_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null and doc_id is not null")
    path = F.when(F.col("doc_id") % 50 == 0, _s("book-", F.col("doc_id"), ".epub")).when(F.col("doc_id") % 20 == 1, _s("_site/", F.col("source"), "/index.html")).otherwise(_s("docs/", F.col("lang"), "/", F.col("doc_id"), ".md"))
    return docs.groupBy(F.col("source").alias("bundle"), path.alias("path")).agg(F.max("n_chars").alias("bytes"))


_FILES = """WITH f AS (SELECT source AS bundle, CASE WHEN doc_id % 50 = 0 THEN 'book-' || doc_id || '.epub' WHEN doc_id % 20 = 1 THEN '_site/' || source || '/index.html' ELSE 'docs/' || lang || '/' || doc_id || '.md' END AS path, max(n_chars) AS bytes
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)"""


@register(
    "bundle_listing",
    _FILES + """, u AS (SELECT bundle, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files, bool_or(path = '_site/' || bundle || '/index.html') AS has_site, coalesce(min(CASE WHEN regexp_matches(path, '^[^/]*\\.epub$') THEN path END), '') AS book FROM f GROUP BY bundle),
    m AS (SELECT source AS bundle, count(*) AS total_documents FROM documents WHERE source <> 'src2' GROUP BY source), c AS (SELECT bundle, count(*) AS chunks FROM f WHERE bytes > 2000 GROUP BY bundle),
    q AS (SELECT source AS slug, max_by(CAST(quality AS DOUBLE), doc_id) AS latest_quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source)
    SELECT u.bundle, CASE WHEN m.bundle IS NULL THEN u.bundle ELSE 'L' || u.bundle END AS language, CASE WHEN m.bundle IS NULL THEN '' ELSE 'Web' END AS source, coalesce(m.bundle, '') AS slug, coalesce(total_documents, 0) AS total_documents, u.bytes, files, coalesce(chunks, 0) AS chunks, has_site, book, latest_quality
    FROM u LEFT JOIN m USING (bundle) LEFT JOIN c USING (bundle) LEFT JOIN q ON q.slug = m.bundle""",
)
def bundle_listing(spark, sf_dir):
    docs, files = table(spark, sf_dir, "documents"), _output_files(spark, sf_dir)
    meta = docs.where("source <> 'src2'").groupBy(F.col("source").alias("bundle")).agg(F.count(F.lit(1)).alias("total_documents")).select("bundle", _s("L", F.col("bundle")).alias("language"), F.lit("Web").alias("source"), F.col("bundle").alias("slug"), "total_documents")
    quality = docs.join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null").select(_s("l", F.col("source")).alias("language"), F.lit("WEB").alias("source_name"), F.col("source").alias("slug"), F.col("quality").cast("double").alias("score"), F.col("doc_id").alias("pos"))
    return R.bundle_listing(meta, files, files.where("bytes > 2000").select("bundle"), quality.withColumnRenamed("source_name", "source"))


@register(
    "output_tree",
    _FILES + """, s AS (SELECT bundle, bytes, string_split(path, '/') AS p FROM f), e AS (SELECT bundle, bytes, p, unnest(range(1, len(p) + 1)) AS depth FROM s),
    t AS (SELECT bundle, array_to_string(p[1:depth], '/') AS path, CAST(depth AS INT) AS depth, bool_or(depth < len(p)) AS is_dir, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM e GROUP BY ALL)
    SELECT bundle, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, depth, is_dir, bytes, files FROM t""",
)
def output_tree(spark, sf_dir):
    return R.output_tree(_output_files(spark, sf_dir))


@register(
    "output_tree_scores",
    _FILES + """ SELECT f.bundle, f.path, v.score FROM f LEFT JOIN (SELECT lower('docs/' || d.lang || '/' || d.doc_id || '.md') AS e, d.doc_id / 10.0 AS score FROM documents d WHERE doc_id % 2 = 0 AND lang IS NOT NULL) v ON v.e = lower(f.path)""",
)
def output_tree_scores(spark, sf_dir):
    validation = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 and lang is not null").select(_s("C:\\out\\Docs\\", F.col("lang"), "\\", F.col("doc_id"), ".MD").alias("document_path"), (F.col("doc_id") / 10).cast("double").alias("score"))
    return R.tree_scores(R.output_tree(_output_files(spark, sf_dir)), validation).select("bundle", "path", "score")


@register("lowest_documents", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents) WHERE place <= 3")
def lowest_documents(spark, sf_dir):
    return R.lowest_documents(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id").select("source", "doc_id", "place")


@register(
    "body_context",
    """SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split('# Head' || chr(10) || '_Source: <x>_' || chr(10) || text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '_Language:') AND NOT starts_with(x, '_Source:'))[1], 1, 240), '') AS context FROM documents""",
)
def body_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.body_context(F.concat(F.lit("# Head\n_Source: <x>_\n"), "text")).alias("context"))


@register("ordered_distinct", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL)")
def ordered_distinct(spark, sf_dir):
    return R.ordered_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@register("typeahead", "SELECT p_name AS language, p_type AS source, CAST(p_size AS VARCHAR) AS version FROM part WHERE contains(lower(p_name), 'al') ORDER BY lower(p_name), lower(p_type), CAST(p_size AS VARCHAR) DESC LIMIT 30")
def typeahead(spark, sf_dir):
    return R.typeahead(table(spark, sf_dir, "part").select(F.col("p_name").alias("language"), F.col("p_type").alias("source"), F.col("p_size").cast("string").alias("version")), "AL")


@register(
    "best_match",
    """SELECT lower(p_brand) AS request, p_type AS source, CAST(p_partkey AS VARCHAR) AS slug FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'PROMO' DESC, p_size = 7 DESC, lower(p_type), lower(p_brand), CAST(p_partkey AS VARCHAR)) = 1""",
)
def best_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entries = part.select(F.col("p_brand").alias("display_name"), F.col("p_type").alias("source"), F.when(F.col("p_size") == 7, "Latest").otherwise("x").alias("version"), F.col("p_partkey").cast("string").alias("slug"))
    return R.best_match(entries, part.select(F.lower("p_brand").alias("request")).distinct(), "promo")


@register("sorted_listing", "SELECT n_name, row_number() OVER (ORDER BY lower(r_name), lower(n_name)) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def sorted_listing(spark, sf_dir):
    rows = R.sorted_listing(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name"), "r_name", "n_name")
    return spark.createDataFrame([(r["n_name"], i + 1) for i, r in enumerate(rows.collect())], "n_name string, place bigint")  # 25 rows: their order is what is asked


@register("cache_view_largest", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 100")
def cache_view_largest(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source"), F.lit("").alias("slug"), F.col("o_orderkey").alias("cache_key"), F.col("o_totalprice").alias("bytes"), F.lit("ttl").alias("policy"), F.col("o_orderdate").alias("fetched_at"))
    return R.cache_view(entries, "largest", "f").limit(100).select("o_orderkey")


@register("stale_catalogs", "SELECT o_orderkey FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 30")
def stale_catalogs(spark, sf_dir):
    return R.stale(table(spark, sf_dir, "orders").withColumn("fetched_at", F.col("o_orderdate").cast("date")), F.lit("1998-01-01").cast("date"), 30).select("o_orderkey")


@register(
    "cache_identity",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'file-' || s_suppkey ELSE 'key' || s_suppkey END AS slug,
      CASE s_suppkey % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'archive' WHEN 2 THEN 'catalog' ELSE 'unknown' END AS source,
      CASE s_suppkey % 4 WHEN 0 THEN 'hub/x' || s_suppkey WHEN 1 THEN 'archive' WHEN 2 THEN 'catalogs' END AS root FROM supplier""",
)
def cache_identity(spark, sf_dir):
    k = F.col("s_suppkey")
    folder = F.when(k % 4 == 0, "Hub").when(k % 4 == 1, "archive").when(k % 4 == 2, "catalogs").otherwise("other")
    rows = table(spark, sf_dir, "supplier").select(k, F.when(k % 2 == 1, _s("key", k, "/page")).alias("key"), F.concat(F.lit("/c/"), folder, _s("/file-", k, ".meta.json")).alias("path"))
    source = R.cache_source(F.col("path"), {"hub": "hub", "archive": "archive", "docset": "docset", "catalogs": "catalog"})
    return rows.select("s_suppkey", R.cache_slug(F.col("key"), F.col("path")).alias("slug"), source.alias("source"),
        R.cache_root(source, _s("x", k), {"hub": ("hub", True), "archive": ("archive", False), "catalog": ("catalogs", False)}).alias("root"))


@register("cache_sidecars", "SELECT '/c/' || n_name || '.meta.json' AS path, sha256(n_name) AS checksum, length(n_name) AS byte_count FROM nation")
def cache_sidecars(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(_s("/c/", F.col("n_name")).alias("path"), F.encode("n_name", "UTF-8").alias("content"))
    rows = R.sidecars(files, F.lit("hub"), F.lit("ttl"))
    return rows.select("path", F.get_json_object("value", "$.checksum").alias("checksum"), F.get_json_object("value", "$.byte_count").cast("bigint").alias("byte_count"))


@register("cache_counters", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS refreshes FROM events GROUP BY user_id")
def cache_counters(spark, sf_dir):
    return R.cache_counters(table(spark, sf_dir, "events").withColumn("refresh", F.col("event_type") == "error"), "user_id")


@register(
    "failure_mapping",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'network_timeout' WHEN o_orderkey % 3 = 0 THEN 'not_found' WHEN o_orderkey % 3 = 1 THEN 'rate_limited' ELSE 'network_timeout' END AS code,
      o_orderkey % 5 = 0 OR o_orderkey % 3 <> 0 AS retriable, CASE WHEN o_orderkey % 2 = 0 THEN 'failed try again' ELSE 'failed' END AS shown,
      CASE WHEN o_orderkey % 2 = 0 THEN 'connection_error' ELSE 'unexpected_error' END AS row_code FROM orders""",
)
def failure_mapping(spark, sf_dir):
    k = F.col("o_orderkey")
    f = R.failure(F.when(k % 3 == 0, 404).when(k % 3 == 1, 429).otherwise(500), k % 5 == 0)
    hint = F.when(k % 2 == 0, "try again").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", f["code"].alias("code"), f["retriable"].alias("retriable"), R.display_text(F.lit("failed"), hint).alias("shown"), R.failure_row(F.when(k % 2 == 0, "ConnectionError"), F.lit("x"))["code"].alias("row_code"))


@register(
    "checkpoint_state",
    """WITH e AS (SELECT conv_id AS run, turn AS seq, CASE role WHEN 'assistant' THEN 'document' WHEN 'system' THEN 'failure' ELSE 'phase' END AS kind, 'fetching' AS phase, 's' || turn AS slug FROM conversations)
    SELECT run, max_by(CASE kind WHEN 'document' THEN 'compiling' WHEN 'failure' THEN 'failed' ELSE phase END, seq) AS phase, count(*) FILTER (kind = 'document') AS emitted, max(CASE WHEN kind = 'document' THEN seq END) AS position,
      's' || max(CASE WHEN kind = 'document' THEN seq END) AS last_slug, count(*) FILTER (kind = 'failure') AS failures FROM e GROUP BY run""",
)
def checkpoint_state(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "document").when(F.col("role") == "system", "failure").otherwise("phase")
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), kind.alias("kind"), F.lit("fetching").alias("phase"), _s("s", F.col("turn")).alias("slug"), F.col("turn").alias("order_hint"))
    return R.checkpoint_state(events)


@register(
    "checkpoint_listing",
    """SELECT CAST(o_custkey AS VARCHAR) AS slug, o_orderstatus AS phase, greatest(0, CAST(epoch(TIMESTAMP '1997-01-01') - epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)) AS age_seconds, o_orderkey % 4 = 0 OR o_custkey % 2 = 0 AS stale FROM orders""",
)
def checkpoint_listing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderstatus").alias("phase"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1).alias("schema_version"))
    return R.checkpoint_listing(rows, F.lit("1997-01-01").cast("timestamp"), orders.where("o_custkey % 2 = 1").select(F.col("o_custkey").cast("string").alias("slug")))


@register("all_jobs", "SELECT job_id, active FROM (SELECT o_orderkey AS job_id, TRUE AS active, o_orderdate AS t FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, FALSE, o_orderdate FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) ORDER BY t DESC, job_id LIMIT 100")
def all_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    return R.all_jobs(rows.where("job_id % 10 = 0"), rows.where("job_id % 5 = 0")).select("job_id", "active")


@register(
    "precedence_merge",
    """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE n_name END AS name FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation WHERE n_nationkey > 5)
    SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(trim(a.name), ''), b.name) AS name FROM a FULL JOIN b ON a.k = b.k""",
)
def precedence_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return R.precedence(rows.where("k < 15").withColumn("name", F.when(F.col("k") % 2 == 0, " ").otherwise(F.col("name"))), rows.where("k > 5").withColumn("name", F.lower("name")), "k", ["name"])


@register("event_lines", "SELECT 'event: ' || event_type || chr(10) || 'data: {\"event_id\":' || event_id || '}' || chr(10) || chr(10) AS line FROM events")
def event_lines(spark, sf_dir):
    return R.event_lines(table(spark, sf_dir, "events"), "event_type", ["event_id"])


@register("report_bundle", "SELECT 'nations' AS part, count(*) AS n FROM nation UNION ALL SELECT 'regions', count(*) FROM region")
def report_bundle(spark, sf_dir):
    return R.reports(nations=table(spark, sf_dir, "nation"), regions=table(spark, sf_dir, "region")).groupBy("part").agg(F.count("record").alias("n"))


@register(
    "path_families",
    """WITH u AS (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages), t AS (SELECT count(*) AS total FROM pages),
    e AS (SELECT '/' || array_to_string(p[1:n], '/') || '/' AS prefix FROM (SELECT p, unnest(range(1, least(3, len(p)) + 1)) AS n FROM u)),
    k AS (SELECT prefix, count(*) AS n FROM e, t GROUP BY prefix, total HAVING count(*) >= greatest(3, ceil(total * 0.05)))
    SELECT prefix, n FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.prefix <> k.prefix AND starts_with(k.prefix, o.prefix))""",
)
def path_families(spark, sf_dir):
    return A.path_families(table(spark, sf_dir, "pages"), "url")
