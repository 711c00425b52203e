"""Scan, filter, dedup and diagnostics queries.

documents stands in for a catalog: source is the topic, doc_id the order, labels the contents that exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..registry import register
from ..sources.tables import table

_CORE = ["src1", "src2", "SRC3 "]
_INCLUDE, _EXCLUDE = ["src0", "src1", "Src2"], ["src1"]
_KEY = "substr(text, 1, 24)"


def _entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_key", F.substring("text", 1, 24))
    known = table(spark, sf_dir, "labels").select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(known, "doc_id", "left").withColumn("content", F.when(F.col("quality").isNotNull(), F.when(F.col("quality") == 0, F.lit(" ")).otherwise(F.col("text"))))


_ENTRIES = f"""WITH known AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
e AS (SELECT d.*, {_KEY} AS doc_key, quality, CASE WHEN quality = 0 THEN ' ' WHEN quality IS NOT NULL THEN text END AS content FROM documents d LEFT JOIN known USING (doc_id))"""


def _reasons_sql(mode: str, boundary: str) -> str:
    allowed = "lower(source) IN ('src1', 'src2', 'src3')" if mode == "important" else "TRUE"
    return f"""{_ENTRIES},
    s AS (SELECT *, {boundary} AS resumed, {allowed} AS ok, doc_key IS NULL OR doc_key = '' OR source IS NULL OR source = '' AS missing FROM e),
    p AS (SELECT *, sum(CASE WHEN NOT missing AND (resumed OR ok) THEN 1 END) OVER (PARTITION BY doc_key ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS place FROM s),
    r AS (SELECT *, CASE WHEN missing THEN 'missing_path_or_type' WHEN resumed THEN 'resumed' WHEN NOT ok THEN 'filtered_mode' WHEN place > 1 THEN 'duplicate_path'
                         WHEN content IS NULL THEN 'missing_content' WHEN trim(content) = '' THEN 'empty_markdown' END AS skip_reason FROM p)"""


def _scan(spark, sf_dir, **options):
    return I.scan_reasons(_entries(spark, sf_dir), key="doc_key", order="doc_id", topic="source", content="content", **options)


@register("scan_full", _reasons_sql("full", "FALSE") + " SELECT doc_id, skip_reason FROM r")
def scan_full(spark, sf_dir):
    return _scan(spark, sf_dir).select("doc_id", "skip_reason")


@register("scan_important_mode", _reasons_sql("important", "FALSE") + " SELECT doc_id, skip_reason FROM r")
def scan_important_mode(spark, sf_dir):
    return _scan(spark, sf_dir, mode="important", core=_CORE).select("doc_id", "skip_reason")


@register("scan_resumed", _reasons_sql("important", "doc_id <= 100") + " SELECT doc_id, skip_reason FROM r")
def scan_resumed(spark, sf_dir):
    return _scan(spark, sf_dir, mode="important", core=_CORE, boundary=100).select("doc_id", "skip_reason")


@register("skip_histogram", _reasons_sql("important", "FALSE") + " SELECT skip_reason, count(*) AS skipped FROM r WHERE skip_reason IS NOT NULL GROUP BY 1")
def skip_histogram(spark, sf_dir):
    return I.skip_histogram(_scan(spark, sf_dir, mode="important", core=_CORE))


@register(
    "scan_diagnostics",
    _reasons_sql("full", "FALSE")
    + """ SELECT source, count(*) AS discovered, count(*) FILTER (skip_reason IS NULL) AS emitted, count(skip_reason) AS skipped,
      round(least(1.0, count(*) FILTER (skip_reason IS NULL) / count(*)), 4) AS success_rate, round(count(skip_reason) / count(*), 4) AS skip_rate FROM r GROUP BY source""",
)
def scan_diagnostics(spark, sf_dir):
    return I.diagnostics(_scan(spark, sf_dir), "source")


@register("inventory_join_missing", f"{_ENTRIES} SELECT doc_id, CASE WHEN content IS NULL THEN 'missing_content' WHEN trim(content) = '' THEN 'empty_markdown' ELSE 'ok' END AS status FROM e")
def inventory_join_missing(spark, sf_dir):
    status = F.when(F.col("content").isNull(), "missing_content").when(F.trim("content") == "", "empty_markdown").otherwise("ok")
    return _entries(spark, sf_dir).select("doc_id", status.alias("status"))


@register("mode_filter_semi", "SELECT doc_id, source FROM documents WHERE lower(source) IN ('src1', 'src2', 'src3')")
def mode_filter_semi(spark, sf_dir):
    core = spark.createDataFrame([(c,) for c in I.topic_filter(_CORE)], "core string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(F.broadcast(core), F.lower("source") == F.col("core"), "left_semi")  # the core topics are a constant


@register(
    "mode_filter_page_types",
    "SELECT doc_id FROM documents WHERE list_has_any(list_transform([lang, source], lambda x: lower(x)), ['fr', 'src4'])",
)
def mode_filter_page_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(I.any_topic_allowed(F.array("lang", "source"), "important", ["FR", "src4"])).select("doc_id")


@register(
    "topic_filter_reasons",
    """SELECT doc_id, CASE WHEN lower(trim(source)) NOT IN ('src0', 'src1', 'src2') THEN 'filtered_topic_include'
                           WHEN lower(trim(source)) IN ('src1') THEN 'filtered_topic_exclude' END AS skip_reason FROM documents""",
)
def topic_filter_reasons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.topic_reason(F.col("source"), _INCLUDE, _EXCLUDE).alias("skip_reason"))


@register("dedup_first_wins", "SELECT doc_id, sha256(text) AS sha FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


@register("dup_groups", "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id, list(doc_id ORDER BY doc_id) AS doc_ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).where("copies > 1")


@register(
    "fragment_references",
    """WITH p AS (SELECT page_id AS pos, 'page ' || page_id AS name, url AS path FROM pages WHERE contains(url, '#')),
    n AS (SELECT split_part(path, '#', 1) AS doc_key, '- ' || name || ': #' || regexp_extract(path, '#(.*)$', 1) AS note, pos FROM p)
    SELECT doc_key, list(note ORDER BY pos) AS references FROM n GROUP BY doc_key""".replace("AS references", 'AS "references"'),
)
def fragment_references(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.concat(F.lit("page "), F.col("page_id")).alias("name"), F.col("url").alias("path"))
    return I.fragment_references(pages)


@register(
    "resume_prefix",
    """WITH known AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
    d AS (SELECT d.doc_id, source, max(CASE WHEN k.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY d.doc_id ROWS UNBOUNDED PRECEDING) AS bad
          FROM documents d LEFT JOIN known k USING (doc_id))
    SELECT source, count(*) AS verified, max(doc_id) AS boundary FROM d WHERE bad = 0 GROUP BY source""",
)
def resume_prefix(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(bad, "doc_id", "left")
    kept = I.verified_prefix(rows, "source", "doc_id", F.col("bad").isNotNull())
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("verified"), F.max("doc_id").alias("boundary"))


@register(
    "preview_estimate",
    f"SELECT count(DISTINCT {_KEY}) AS documents, list_sort(list(DISTINCT source)) AS topics FROM documents WHERE lower(source) IN ('src1', 'src2', 'src3')",
)
def preview_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(I.mode_allows(F.col("source"), "important", _CORE))
    return docs.agg(F.count_distinct(F.substring("text", 1, 24)).alias("documents"), F.sort_array(F.collect_set("source")).alias("topics"))


@register(
    "event_demux",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def event_demux(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@register(
    "event_fold",
    """SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS discovered, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS emitted,
      count(*) FILTER (event_type = 'click') AS documents FROM events""",
)
def event_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shaped = events.select(
        F.when(F.col("event_type") == "click", "document").otherwise("stats").alias("event_type"), F.lit(None).cast("bigint").alias("count"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("discovered"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("emitted"),
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("source_url"),
    )
    return I.fold_events(shaped).select("discovered", "emitted", "documents")
