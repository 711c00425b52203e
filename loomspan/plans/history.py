"""Manifests, run history, quality, caches: documents by language, events as runs (user is the language, value the score)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import manifest as M
from ..operators import quality as Q
from ..registry import register
from ..sources.tables import table

_PATH = "source || '/' || doc_id || '.md'"


def _path():
    return F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".md"))


@register("manifest_documents", f"SELECT lang, {_PATH} AS path, sha256(text) AS sha256, length(text) AS chars FROM documents")
def manifest_documents(spark, sf_dir):
    return M.document_hashes(table(spark, sf_dir, "documents"), "lang", _path(), "text")


@register(
    "manifest_aggregate",
    f"""SELECT lang, count(*) AS document_count, CAST(sum(length(text)) AS BIGINT) AS total_chars,
      sha256(string_agg({_PATH} || ':' || sha256(text), chr(10) ORDER BY {_PATH} || ':' || sha256(text))) AS content_sha256 FROM documents GROUP BY lang""",
)
def manifest_aggregate(spark, sf_dir):
    return M.manifests(M.document_hashes(table(spark, sf_dir, "documents"), "lang", _path(), "text"), "lang")


def _two_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    now = M.document_hashes(docs.where("doc_id % 10 <> 3"), "lang", _path(), "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = M.document_hashes(docs.where("doc_id % 10 <> 4 and lang <> 'es'").withColumn("text", edited), "lang", _path(), "text")
    return now, before


_DIFF = f"""WITH now AS (SELECT lang, {_PATH} AS path, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 3),
before AS (SELECT lang, {_PATH} AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 10 <> 4 AND lang <> 'es'),
diff AS (SELECT lang, path, CASE WHEN b.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN n.sha <> b.sha THEN 'changed' END AS status
  FROM now n FULL JOIN before b USING (lang, path) WHERE lang IN (SELECT lang FROM before))"""


@register("manifest_diff", _DIFF + " SELECT lang, path, status FROM diff WHERE status IS NOT NULL")
def manifest_diff(spark, sf_dir):
    return M.differences(*_two_runs(spark, sf_dir), "lang")


@register(
    "manifest_diff_summary",
    _DIFF + " SELECT lang, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed FROM diff WHERE status IS NOT NULL GROUP BY lang",
)
def manifest_diff_summary(spark, sf_dir):
    return M.summary(M.differences(*_two_runs(spark, sf_dir), "lang"), "lang")


@register(
    "manifest_run_differences",
    """WITH r AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type AS path, max(event_id) AS sha FROM events GROUP BY ALL),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY run) AS k FROM r), names AS (SELECT DISTINCT user_id, run, k FROM n),
    d AS (SELECT user_id, k, path, CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS status
      FROM (SELECT user_id, k, path, sha FROM n) a FULL JOIN (SELECT user_id, k + 1 AS k, path, sha FROM n) b USING (user_id, k, path))
    SELECT user_id, run, path, status FROM d JOIN names USING (user_id, k) WHERE status IS NOT NULL AND k > 1""",
)
def manifest_run_differences(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("run"), F.col("event_type").alias("path")).agg(F.max("event_id").alias("sha256"))
    return M.run_differences(runs, "user_id", "run")


@register("history_retention", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def history_retention(spark, sf_dir):
    return M.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@register(
    "history_prune_plan",
    "SELECT event_type, count(*) AS removed FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 20) GROUP BY event_type",
)
def history_prune_plan(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    keep = M.newest(events, "event_type", [F.desc("ts"), F.desc("event_id")], 20).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(keep, "event_type").select("event_type", (F.col("n") - F.col("kept")).alias("removed")).where("removed > 0")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@register(
    "trend_telemetry_sums",
    f"""SELECT user_id, count(*) AS runs, CAST(sum({_K}) AS BIGINT) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
      CAST(sum(CASE WHEN event_type = 'click' THEN {_K} ELSE 0 END) AS BIGINT) AS cache_hits FROM events GROUP BY user_id""",
)
def trend_telemetry_sums(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(k).alias("requests"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("failures"),
        F.sum(F.when(F.col("event_type") == "click", k).otherwise(0)).alias("cache_hits"),
    )


@register(
    "trend_telemetry_deltas",
    f"SELECT event_id, user_id, {_K} - coalesce(lag({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events",
)
def trend_telemetry_deltas(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (k - F.coalesce(F.lag(k).over(w), F.lit(0))).alias("delta"))


@register("trend_latest", "SELECT user_id, max_by(value, (ts, event_id)) AS latest_score, max_by(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS latest_type FROM events GROUP BY user_id")
def trend_latest(spark, sf_dir):
    at = F.struct("ts", "event_id")
    other = F.when(F.col("event_type") != "view", at)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", at).alias("latest_score"), F.max_by("event_type", other).alias("latest_type"))


@register("issue_histogram", "SELECT user_id, event_type AS code, count(*) AS n FROM events GROUP BY ALL")
def issue_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("quality_latest", "SELECT lower(event_type) AS source, user_id AS slug, max_by(value, (CAST(ts AS DATE), event_id)) AS score FROM events GROUP BY ALL")
def quality_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return Q.latest_by(events, [F.lower("event_type").alias("source"), F.col("user_id").alias("slug")], F.col("value"), F.struct(F.to_date("ts"), "event_id"), "score")


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("Lang"), F.col("user_id")).alias("language"), F.col("event_type").alias("source"), F.round("value", 2).alias("score"), F.to_date("ts").alias("run_date"), F.col("event_id").alias("pos")
    )


_HISTORY = "WITH h AS (SELECT 'Lang' || user_id AS language, event_type AS source, round(value, 2) AS score, CAST(ts AS DATE) AS run_date, event_id AS pos FROM events)"


@register("preferred_source", _HISTORY + " SELECT lower(language) AS language, max_by(source, (score, run_date, pos)) AS preferred_source FROM h GROUP BY 1")
def preferred_source(spark, sf_dir):
    return Q.preferred_source(_history(spark, sf_dir), "language", "source", "score", "run_date", "pos")


@register(
    "quality_trend_lag",
    _HISTORY + """, l AS (SELECT lower(language) AS language, score, lag(score) OVER (PARTITION BY lower(language) ORDER BY pos) AS before, row_number() OVER (PARTITION BY lower(language) ORDER BY pos DESC) AS n FROM h)
    SELECT language, CASE WHEN before IS NULL THEN '' WHEN score - before > 0.01 THEN 'up' WHEN score - before < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM l WHERE n = 1""",
)
def quality_trend_lag(spark, sf_dir):
    return Q.last_trend(_history(spark, sf_dir), "language", "score", "pos")


@register("quality_last_n", _HISTORY + " SELECT language, pos, score FROM h QUALIFY row_number() OVER (PARTITION BY language ORDER BY run_date DESC, pos DESC) <= 10")
def quality_last_n(spark, sf_dir):
    return Q.last_n(_history(spark, sf_dir), "language", "run_date", "pos", 10).select("language", "pos", "score")


@register(
    "cache_summary_rollup",
    "SELECT source, count(*) AS entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ROLLUP (source)",
)
def cache_summary_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("b"))
    return docs.rollup("source").agg(F.count(F.lit(1)).alias("entries"), F.sum("b").alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register(
    "catalog_tree_rollup",
    "SELECT r_name, n_name, count(*) AS customers, grouping(r_name) + grouping(n_name) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def catalog_tree_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), (F.grouping("r_name") + F.grouping("n_name")).cast("bigint").alias("depth"))


@register(
    "support_level_pivot",
    "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) AS other FROM documents GROUP BY source",
)
def support_level_pivot(spark, sf_dir):
    level = F.when(F.col("lang").isin("en", "de", "fr"), F.col("lang")).otherwise("other")
    return table(spark, sf_dir, "documents").withColumn("level", level).groupBy("source").pivot("level", ["en", "de", "fr", "other"]).count().na.fill(0)


_NOW = "2024-02-01 00:00:00"
_POLICY = "CASE event_id % 4 WHEN 0 THEN 'use-if-present' WHEN 1 THEN 'ttl' WHEN 2 THEN 'always-refresh' ELSE 'validate-if-possible' END"


@register(
    "cache_decision",
    f"""WITH e AS (SELECT event_id, {_POLICY} AS policy, epoch(TIMESTAMP '{_NOW}' - ts) / 3600 AS age FROM events)
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'force_refresh' WHEN event_id % 11 = 0 AND event_id % 2 = 0 THEN 'cache_budget_exceeded' WHEN event_id % 11 = 0 THEN 'missing_cache'
      WHEN event_id % 17 = 0 THEN 'missing_metadata' WHEN event_id % 19 = 0 THEN 'identity_mismatch' WHEN policy = 'always-refresh' THEN 'always_refresh'
      WHEN policy = 'ttl' AND age >= 240 THEN 'ttl_expired' WHEN policy = 'ttl' THEN 'ttl_fresh' WHEN policy = 'validate-if-possible' THEN 'validate_with_conditional' ELSE 'use_present' END AS reason,
      CASE WHEN event_id % 13 = 0 THEN TRUE WHEN event_id % 11 = 0 AND event_id % 2 = 0 THEN FALSE WHEN event_id % 11 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN TRUE
      WHEN policy IN ('always-refresh', 'validate-if-possible') THEN TRUE WHEN policy = 'ttl' THEN age >= 240 ELSE FALSE END AS refresh FROM e""",
)
def cache_decision(spark, sf_dir):
    k = F.col("event_id")
    policy = F.when(k % 4 == 0, "use-if-present").when(k % 4 == 1, "ttl").when(k % 4 == 2, "always-refresh").otherwise("validate-if-possible")
    age = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp"), F.lit(_NOW).cast("timestamp")) / 3600
    decision = Q.cache_decision(policy, age, F.lit(240), k % 13 == 0, k % 11 != 0, k % 17 != 0, k % 19 != 0, k % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", decision.alias("d")).select("event_id", "d.reason", "d.refresh")


@register(
    "source_health",
    f"""SELECT event_type AS source, round(greatest(0, epoch(TIMESTAMP '{_NOW}' - max(ts)) / 3600), 2) AS age_hours,
      CASE WHEN greatest(0, epoch(TIMESTAMP '{_NOW}' - max(ts)) / 3600) > 168 THEN 'degraded' ELSE 'ok' END AS health FROM events GROUP BY event_type""",
)
def source_health(spark, sf_dir):
    latest = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("at"))
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col("at").cast("timestamp"), F.lit(_NOW).cast("timestamp")) / 3_600_000_000)
    return latest.select("source", F.round(age, 2).alias("age_hours"), Q.health(age, F.lit(False)).alias("health"))


@register(
    "next_refresh_due",
    f"SELECT event_id, epoch_us(CASE WHEN {_POLICY} = 'ttl' THEN ts + to_hours(coalesce(CAST(nullif(event_id % 5, 0) AS INTEGER), 24)) END) AS due_us FROM events",
)
def next_refresh_due(spark, sf_dir):
    k = F.col("event_id")
    policy = F.when(k % 4 == 0, "use-if-present").when(k % 4 == 1, "ttl").when(k % 4 == 2, "always-refresh").otherwise("validate-if-possible")
    ttl = F.when(k % 5 != 0, (k % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(Q.next_refresh(F.col("ts").cast("timestamp"), policy, ttl)).alias("due_us"))


_LABELLED = "SELECT source, count(*) AS documents, avg(quality) AS success FROM documents JOIN labels USING (doc_id) GROUP BY source"


@register(
    "confidence_class",
    f"WITH s AS ({_LABELLED}) SELECT source, CASE WHEN documents >= 200 AND success >= 0.9 THEN 'high' WHEN documents >= 50 AND success >= 0.7 THEN 'medium' WHEN documents > 0 THEN 'low' ELSE '' END AS confidence, "
    "CASE WHEN success >= 0.9 THEN 'A' WHEN success >= 0.75 THEN 'B' WHEN success >= 0.6 THEN 'C' ELSE 'D' END AS grade FROM s",
)
def confidence_class(spark, sf_dir):
    stats = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.avg("quality").alias("success"))
    return stats.select("source", Q.confidence(F.col("documents"), F.col("success")).alias("confidence"), Q.grade(F.col("success")).alias("grade"))


@register(
    "sparkline",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, min(n) OVER (PARTITION BY user_id) AS lo, max(n) OVER (PARTITION BY user_id) AS hi FROM d)
    SELECT user_id, string_agg(substr('▁▂▃▄▅▆▇█', CAST(CASE WHEN hi = lo THEN 0 ELSE floor((n - lo) / (hi - lo) * 7) END AS INTEGER) + 1, 1), '' ORDER BY day) AS sparkline FROM m GROUP BY user_id""",
)
def sparkline(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return Q.sparkline(days, "user_id", "day", "n")


@register("benchmark_cv", "SELECT l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) / avg(l_quantity) AS cv FROM lineitem GROUP BY l_returnflag")
def benchmark_cv(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("mean"), (F.stddev_pop(q) / F.avg(q)).alias("cv"))


@register(
    "size_estimate",
    """SELECT lang, count(*) AS n, CAST(sum(coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars END, CASE WHEN source = 'src1' THEN 30000000 ELSE 80000000 END)) AS BIGINT) AS bytes,
      CAST(sum(coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars END, CASE WHEN source = 'src1' THEN 30000000 ELSE 80000000 END)) AS DOUBLE) * 0.25 AS important_bytes FROM documents GROUP BY lang""",
)
def size_estimate(spark, sf_dir):
    size = F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")), F.when(F.col("source") == "src1", 30_000_000).otherwise(80_000_000))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), (F.sum(size) * 0.25).alias("important_bytes"))


@register("storage_usage", "SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(CASE WHEN lang = 'en' THEN octet_length(encode(text)) ELSE 0 END) AS BIGINT) AS markdown_bytes FROM documents GROUP BY source")
def storage_usage(spark, sf_dir):
    b = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(b).alias("bytes"), F.sum(F.when(F.col("lang") == "en", b).otherwise(0)).alias("markdown_bytes"))


@register("latency_p95", "SELECT event_type, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile(value, 0.95)").alias("p95"))


_TREE = "WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts, octet_length(encode(html)) AS b FROM pages)"


@register(
    "output_tree_usage",
    _TREE + " SELECT prefix, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS prefix, b FROM p) GROUP BY prefix",
)
def output_tree_usage(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    pages = table(spark, sf_dir, "pages").select(parts.alias("parts"), F.octet_length("html").alias("b")).where(F.size("parts") > 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    return pages.select(F.explode(prefixes).alias("prefix"), "b").groupBy("prefix").agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))
