"""Source adapters as DataFrame steps: archives of Markdown pages, anchor indexes, manifests and their upkeep.

What is fetched from a network comes in as a table; what an adapter decides about it is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter

MARKER = "/files/en-us/"
WEB_API = "web/api"


# Archives whose pages are the members ending in /index.md below a marker.


def member_relative(member: Column, marker: str = MARKER) -> Column:
    """The path behind the first marker; null without one."""
    at = F.locate(marker, member)
    return F.when(at > 0, F.substr(member, at + len(marker)))


def member_area(relative: Column) -> Column:
    """The first folder of a page, two folders under web/; null for what is no page of an area."""
    parts = F.filter(F.split(relative, "/"), lambda x: ~x.isin("", "."))
    first = F.get(parts, 0)
    area = F.when((first == "web") & (F.size(parts) >= 3), F.concat_ws("/", first, F.get(parts, 1))).when(F.size(parts) >= 2, first)
    return F.when(F.element_at(parts, -1) == "index.md", area)


def area_slug(area: Column) -> Column:
    under_web = (F.split_part(area, F.lit("/"), F.lit(1)) == "web") & (F.size(F.split(area, "/")) == 2)
    plain = F.lower(F.regexp_replace(F.regexp_replace(area, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(area == WEB_API, "web-apis").when(under_web, F.split_part(area, F.lit("/"), F.lit(2))).otherwise(F.when(plain == "", "index").otherwise(plain))


def area_display(area: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.regexp_extract(area, "([^/]*)$", 1), "[_-]", " "), r"\s+"), lambda x: x != "")
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(area == WEB_API, "Web APIs").when(label == "", area).otherwise(label)


def archive_pages(members: DataFrame, marker: str = MARKER) -> DataFrame:
    """Members (member, ...) that are pages, with ``relative`` and ``area``."""
    rows = members.where(F.col("member").endswith("/index.md")).withColumn("relative", member_relative(F.col("member"), marker))
    return rows.withColumn("area", member_area(F.col("relative"))).where("area is not null")


def archive_index(members: DataFrame, marker: str = MARKER) -> DataFrame:
    """(area, n_members, root_member): areas with the member that describes them, null if there is none."""
    root = F.when(F.col("relative") == F.concat("area", F.lit("/index.md")), F.col("member"))
    return archive_pages(members, marker).groupBy("area").agg(F.count(F.lit(1)).alias("n_members"), F.max(root).alias("root_member"))


def archive_members(members: DataFrame, marker: str = MARKER) -> DataFrame:
    """(area, member, order_hint): the members of each area in order of their names."""
    place = F.row_number().over(Window.partitionBy("area").orderBy("member")) - 1
    return archive_pages(members, marker).select("area", "member", place.alias("order_hint"))


def archive_valid(stored: DataFrame, found: DataFrame, areas: DataFrame) -> DataFrame:
    """(archive, area, valid): whether a stored index (archive, size, mtime, sha256, area) still describes the archive and lists the area."""
    now = found.select("archive", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"), F.col("sha256").alias("sha256_now"))
    listed = areas.select("archive", "area", F.lit(True).alias("listed"))
    rows = stored.join(now, "archive", "left").join(listed, ["archive", "area"], "left")
    same = (F.col("size") == F.col("size_now")) & (F.col("mtime") == F.col("mtime_now")) & (F.col("sha256") == F.col("sha256_now"))
    return rows.select("archive", "area", F.coalesce(same & F.col("listed"), F.lit(False)).alias("valid"))


def _meta(name: str) -> Column:
    return F.nullif(F.trim(F.get_json_object("head.meta", f"$['{name}']")), F.lit(""))


def archive_catalog(members: DataFrame, supported: list[str], aliases: dict[str, list[str]] | None = None, marker: str = MARKER) -> DataFrame:
    """(slug, display_name, area, page_slug, aliases, support_level, document_count) of the areas that have a root member; members hold ``content``."""
    pages = archive_pages(members, marker)
    counts = pages.groupBy("area").agg(F.count(F.lit(1)).alias("document_count"))
    roots = pages.where(F.col("relative") == F.concat("area", F.lit("/index.md"))).groupBy("area").agg(F.max_by("content", "member").alias("content"))
    rows = roots.select("area", frontmatter.parse(F.col("content")).alias("head")).join(counts, "area")
    slug = area_slug(F.col("area"))
    known = F.create_map(*[x for k, v in (aliases or {"": []}).items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))])
    return rows.select(
        slug.alias("slug"), F.coalesce(_meta("title"), area_display(F.col("area"))).alias("display_name"), "area", F.coalesce(_meta("slug"), F.col("area")).alias("page_slug"),
        F.coalesce(F.element_at(known, F.col("area")), F.array(slug)).alias("aliases"), F.when(F.col("area").isin(*supported), "supported").otherwise("experimental").alias("support_level"), "document_count",
    )


def archive_documents(members: DataFrame, area: str, core: list[str] = (), mode: str = "full", after: int | None = None, marker: str = MARKER) -> DataFrame:
    """(member, order_hint, topic, slug, title, page_slug, markdown, skip_reason) of one area's pages, skipped ones labelled.

    Skipped are pages up to the position ``after`` and, in mode important with core types, pages of no core type.
    """
    pages = archive_pages(members, marker).where(F.col("area") == area)
    rows = pages.withColumn("head", frontmatter.parse(F.col("content")))
    folder = F.filter(F.split(F.regexp_replace(F.substr("relative", F.lit(len(area) + 2)), "/?index\\.md$", ""), "/"), lambda x: x != "")
    rows = rows.withColumn("folder", folder)
    types = F.get_json_object("head.meta", "$['page-type']")
    listed = F.coalesce(F.from_json(types, "array<string>"), F.filter(F.array(F.trim(types)), lambda x: x != ""))
    hit = F.exists(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.lower(x).isin([c.lower() for c in core]))
    filtered = ~hit if mode == "important" and core else F.lit(False)
    path = F.array_join("folder", "/")
    dashed = F.lower(F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    words = lambda x: F.initcap(F.regexp_replace(x, "_", " "))
    # Pages are read where they lie; only what has been made of them is gathered to be numbered.
    made = rows.select(
        "member", "area", F.coalesce(F.nullif(words(F.coalesce(F.get("folder", 0), F.lit("reference"))), F.lit("")), F.lit("Reference")).alias("topic"),
        F.when(dashed == "", "index").otherwise(dashed).alias("slug"), F.coalesce(_meta("title"), F.regexp_replace(F.coalesce(F.try_element_at("folder", F.lit(-1)), F.lit("")), "_", " ")).alias("title"),
        F.coalesce(_meta("slug"), path).alias("page_slug"), F.trim("head.body").alias("markdown"), filtered.alias("filtered"),
        (F.col("head.warning") != "").alias("malformed_frontmatter"),
    )
    early = F.lit(False) if after is None else F.col("order_hint") <= after
    reason = F.when(early, "checkpoint_resume_skip").when(F.col("filtered"), "filtered_mode")
    placed = made.withColumn("order_hint", F.row_number().over(Window.partitionBy("area").orderBy("member")) - 1)
    return placed.select("member", "order_hint", "topic", "slug", "title", "page_slug", "markdown", reason.alias("skip_reason"), "malformed_frontmatter")


# Catalogs read from an index page of anchors.


def anchor_catalog(pages: DataFrame, html: str = "html", folder: str = "/cheat_sheets/") -> DataFrame:
    """(slug, display_name, homepage, aliases): docsets that anchors of index pages lead to, the first anchor of each."""
    pattern = rf'(?is)<a\s[^>]*?href="([^"]*{folder}([^/"]+)\.docset[^"]*)"[^>]*>(.*?)</a>'
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "href"), (2, "slug"), (3, "inner"))])
    rows = pages.select(F.xxhash64(html).alias("page"), F.posexplode(parts).alias("pos", "a")).select("page", "pos", "a.href", F.trim("a.slug").alias("slug"), "a.inner").where("slug <> ''")
    first = rows.groupBy("slug").agg(F.min_by(F.struct("href", "inner"), F.struct("pos", "page")).alias("a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a.inner", "<[^>]*>", " "), r"\s+", " "))
    display = F.when(text == "", F.col("slug")).otherwise(text)
    homepage = F.when(F.col("a.href").startswith("/"), F.col("a.href")).otherwise(F.concat(F.lit("/"), "a.href"))
    return first.select("slug", display.alias("display_name"), homepage.alias("homepage"), F.array(F.lower(display), F.regexp_replace("slug", "_", " ")).alias("aliases"))


def enriched(catalog: DataFrame, sizes: DataFrame, stats: DataFrame) -> DataFrame:
    """The catalog with size_hint and last_modified of its downloads (slug, bytes, last_modified) and a confidence from its quality (slug, documents, success)."""
    from .quality import confidence

    known = sizes.groupBy("slug").agg(F.max("bytes").alias("bytes"), F.max("last_modified").alias("last_modified"))
    quality = stats.select("slug", confidence(F.col("documents"), F.col("success")).alias("confidence"))
    rows = catalog.join(known, "slug", "left").join(quality, "slug", "left")
    return rows.withColumn("size_hint", F.when(F.col("bytes") > 0, F.col("bytes"))).withColumn("confidence", F.nullif("confidence", F.lit(""))).drop("bytes")


def quality_stats(runs: DataFrame) -> DataFrame:
    """(slug, indexed, emitted, success): entries, documents and the share that converted, to four places."""
    rows = runs.groupBy("slug").agg(F.count(F.lit(1)).alias("indexed"), F.count_if("emitted").alias("emitted"))
    return rows.withColumn("success", F.round(F.col("emitted") / F.greatest(F.col("indexed"), F.lit(1)), 4))


def or_cached(fresh: DataFrame, cached: DataFrame, key: str = "source") -> DataFrame:
    """Each source's fresh entries, its cached ones where there are none; ``fallback`` tells which."""
    missing = cached.join(fresh.select(key).distinct(), key, "left_anti").withColumn("fallback", F.lit(True))
    return fresh.withColumn("fallback", F.lit(False)).unionByName(missing)


def refresh_status(manifests: DataFrame) -> DataFrame:
    """(source, status, supported, experimental, ignored) of manifests (source, entry_count, errors, fallback_used, support_levels)."""
    failed = (F.size("errors") > 0) & (F.col("entry_count") == 0)
    level = lambda name: F.size(F.filter("support_levels", lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("supported")) == name))
    return manifests.select("source", F.when(failed, "failed").when(F.col("fallback_used"), "fallback").otherwise("refreshed").alias("status"), *[level(n).alias(n) for n in ("supported", "experimental", "ignored")])


def core_topics(catalog: DataFrame, topics: DataFrame) -> DataFrame:
    """The catalog with ``core_topics``: those of the slug, else of the family (an empty list counts as none)."""
    some = topics.where(F.size("topics") > 0)
    rows = catalog.join(some.select(F.col("name").alias("slug"), F.col("topics").alias("by_slug")), "slug", "left").join(some.select(F.col("name").alias("family"), F.col("topics").alias("by_family")), "family", "left")
    return rows.withColumn("core_topics", F.coalesce("by_slug", "by_family", F.array().cast("array<string>"))).drop("by_slug", "by_family")


# Docsets: rows of a search index and the files that are there.


def with_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows (docset, path) whose file, without its fragment, exists."""
    there = files.select("docset", F.col("path").alias("file")).distinct()
    return rows.withColumn("file", F.split_part("path", F.lit("#"), F.lit(1))).join(there, ["docset", "file"], "left_semi").drop("file")


def accepted(rows: DataFrame, files: DataFrame, first: int = 200) -> DataFrame:
    """(docset, path): the first row, by type and name, whose file exists among the first rows of each docset; docsets without one have no row."""
    place = F.row_number().over(Window.partitionBy("docset").orderBy("type", "name", "path"))
    head = with_files(rows.withColumn("place_in_index", place).where(F.col("place_in_index") <= first), files)
    return head.groupBy("docset").agg(F.min_by("path", "place_in_index").alias("path"))


def probe_candidates(catalog: DataFrame, most_bytes: int, head: int, take: int) -> DataFrame:
    """(slug, size): of the first entries those that are small enough or of unknown size, the smallest first, unknown ones last."""
    some = catalog.orderBy("pos").limit(head).where(F.col("size").isNull() | (F.col("size") <= most_bytes))
    return some.orderBy(F.asc_nulls_last("size"), "pos").limit(take).select("slug", "size")


# URLs of a crawl.


def crawl(pages: DataFrame, key: str, url: str, html: str, prefix: Column | None = None, most: int = 5) -> DataFrame:
    """(key, target, place): the page itself, then links in order, resolved, http(s) only, below a path prefix, once each, ``most`` pages in all.

    The default prefix is the folder of the page's own path.
    """
    from ..functions.url import resolve_link

    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = pages.select(key, F.col(url).alias("from"), F.posexplode(hrefs).alias("pos", "href")).where(F.trim("href") != "")
    resolved = links.select(key, "from", (F.col("pos") + 1).alias("pos"), resolve_link(F.trim("href"), F.col("from")).alias("target"))
    own = pages.select(key, F.col(url).alias("from"), F.lit(0).alias("pos"), F.col(url).alias("target"))
    path = F.regexp_extract("target", r"^https?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract("from", r"^https?://[^/?#]*([^?#]*/)?", 1) if prefix is None else prefix
    rows = resolved.where(F.col("target").rlike("^https?://")).where(F.startswith(path, folder)).unionByName(own)
    first = rows.groupBy(key, "target").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos")).cast("bigint")
    return first.withColumn("place", place).where(F.col("place") <= most).select(key, "target", "place")


def path_families(urls: DataFrame, url: str, depth: int = 3, least: int = 3, share: float = 0.05) -> DataFrame:
    """(prefix, n): path prefixes of up to three folders that hold enough documents, none below another."""
    parts = F.filter(F.split(F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    prefixes = urls.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.greatest(F.size(parts), F.lit(1)))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("prefix"))
    counts = prefixes.where("prefix <> '//'").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(urls.agg(F.count(F.lit(1)).alias("total"))))  # one row
    kept = counts.where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))).select("prefix", "n")
    outer = kept.select(F.col("prefix").alias("outer"))
    folders = F.filter(F.split("prefix", "/"), lambda x: x != "")
    shorter = kept.select("prefix", F.explode_outer(F.transform(F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda n: n < F.size(folders)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(folders, 1, n), "/"), F.lit("/")))).alias("outer"))
    inside = shorter.join(outer, "outer", "left_semi").select("prefix").distinct()
    return kept.join(inside, "prefix", "left_anti")

