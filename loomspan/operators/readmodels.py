"""Read models over what runs leave behind: bundles, output trees, reports, caches, checkpoints, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category: what to fetch for it; a set, in alphabetical order.
PRESETS = {
    "backend": "Docker,Go,HTTP,Java,Kubernetes,Node.js,PostgreSQL,Python,Redis,Rust,SQLite,nginx",
    "data": "Matplotlib,NumPy,PostgreSQL,PyTorch,Python,R,SQLite,TensorFlow,pandas,scikit-learn",
    "devops": "Ansible,Bash,Docker,Git,HTTP,Kubernetes,Terraform,nginx",
    "frontend": "Angular,CSS,HTML,JavaScript,React,Svelte,Tailwind CSS,TypeScript,Vue.js,Web APIs",
    "mobile": "Dart,JavaScript,Kotlin,React Native,Swift,TypeScript",
    "python-stack": "Django,FastAPI,Flask,NumPy,PostgreSQL,Python,Redis,SQLAlchemy,pandas,pytest",
    "systems": "Bash,C,C++,Go,Rust",
    "webapp": "CSS,Docker,Express,Git,HTML,HTTP,JavaScript,Node.js,PostgreSQL,React,Svelte,Tailwind CSS,TypeScript,Vue.js,Web APIs,WebAssembly,nginx",
}


def presets(spark, table: dict[str, str] = PRESETS) -> DataFrame:
    """(preset, request)."""
    return spark.createDataFrame([(k, x) for k, v in table.items() for x in v.split(",")], "preset string, request string")


def categories(languages: DataFrame, preset_rows: DataFrame, language: str = "language") -> DataFrame:
    """(language, categories): the presets that name a language, in order, letter case aside; languages of none are left out."""
    named = preset_rows.select("preset", F.lower("request").alias("low")).distinct()
    rows = languages.select(language, F.lower(language).alias("low")).join(named, "low")
    return rows.groupBy(language).agg(F.sort_array(F.collect_set("preset")).alias("categories"))  # as many as there are presets at most


# Bundles and trees.


def usage(files: DataFrame, bundle: str = "bundle") -> DataFrame:
    """(bundle, bytes, files) of (bundle, path, bytes)."""
    return files.groupBy(bundle).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def bundle_listing(meta: DataFrame, files: DataFrame, chunks: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a bundle that has files: its metadata, sizes, chunk count, site and book, and latest quality score.

    meta (bundle, language, source, slug, total_documents), files (bundle, path, bytes), chunks (bundle, ...), quality (language, source, slug, score, pos).
    """
    marks = files.groupBy("bundle").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max(F.col("path") == F.concat(F.lit("_site/"), "bundle", F.lit("/index.html"))).alias("has_site"),
        F.coalesce(F.min(F.when(F.col("path").rlike(r"^[^/]*\.epub$"), F.col("path"))), F.lit("")).alias("book"),
    )
    counted = chunks.groupBy("bundle").agg(F.count(F.lit(1)).alias("chunks"))
    latest = quality.groupBy(F.lower("language").alias("lang_key"), F.lower("source").alias("source_key"), "slug").agg(F.max_by("score", "pos").alias("latest_quality"))
    rows = marks.join(meta, "bundle", "left").join(counted, "bundle", "left")
    rows = rows.withColumn("lang_key", F.lower(F.coalesce("language", "bundle"))).withColumn("source_key", F.lower(F.coalesce("source", F.lit(""))))
    rows = rows.join(latest, ["lang_key", "source_key", "slug"], "left")
    return rows.select(
        "bundle", F.coalesce("language", "bundle").alias("language"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("slug", F.lit("")).alias("slug"), F.coalesce("total_documents", F.lit(0)).alias("total_documents"),
        "bytes", "files", F.coalesce("chunks", F.lit(0)).alias("chunks"), "has_site", "book", "latest_quality",
    )


def output_tree(files: DataFrame) -> DataFrame:
    """(bundle, path, parent, name, depth, is_dir, bytes, files): files and folders; ordering by path gives the tree, siblings by name."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = files.select("bundle", "bytes", parts.alias("parts")).select("bundle", "bytes", F.size("parts").alias("n"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    path = F.array_join(F.slice("parts", 1, F.col("depth")), "/")
    nodes = rows.groupBy("bundle", path.alias("path"), "depth").agg(F.max(F.col("depth") < F.col("n")).alias("is_dir"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return nodes.select("bundle", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "depth", "is_dir", "bytes", "files")


def tree_scores(tree: DataFrame, validation: DataFrame) -> DataFrame:
    """Files of the tree with the score of the validated document (document_path, score) whose path ends in theirs, letter case aside.

    Suffixes are joined by equality, one row a folder of the validated path.
    """
    parts = F.split(F.lower(F.regexp_replace("document_path", r"\\", "/")), "/")
    ends = validation.select("score", "document_path", parts.alias("p")).select("score", "document_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", n, F.size("p")), "/"))).alias("end"))
    first = ends.groupBy("end").agg(F.min_by("score", "document_path").alias("score"))
    return tree.where("not is_dir").withColumn("end", F.lower("path")).join(first, "end", "left").drop("end")


def lowest_documents(results: DataFrame, by: str, score: str, order: str, n: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(score, order))
    return results.withColumn("place", place.cast("bigint")).where(F.col("place") <= n)


def body_context(text: Column, most: int = 240) -> Column:
    """The first line of a document that is neither blank, heading nor its language or source line, cut for show."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x))  # trim itself would take the line's number for the characters to trim
    plain = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("_Language:") & ~x.startswith("_Source:"))
    return F.coalesce(F.substring(F.get(plain, 0), 1, most), F.lit(""))


def ordered_distinct(rows: DataFrame, by: str, item: str, order: str) -> DataFrame:
    """(by, item, place): each item once, where it came first."""
    first = rows.groupBy(by, item).agg(F.min(order).alias("at"))
    return first.select(by, item, F.row_number().over(Window.partitionBy(by).orderBy("at")).cast("bigint").alias("place"))


def reports(**parts: DataFrame) -> DataFrame:
    """(part, record): the report bundle, each part's rows as JSON under its name."""
    whole = None
    for name, rows in parts.items():
        some = rows.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("record"))
        whole = some if whole is None else whole.unionByName(some)
    return whole


# Catalog views.


def typeahead(catalog: DataFrame, text: str, n: int = 30) -> DataFrame:
    """(language, source, version) of entries that hold the text, letter case aside, newest version first."""
    hit = F.contains(F.lower("language"), F.lit(text.lower()))
    return catalog.where(hit).orderBy(F.lower("language"), F.lower("source"), F.desc(F.lower("version"))).limit(n).select("language", "source", "version")


def best_match(catalog: DataFrame, wanted: DataFrame, preferred: str = "") -> DataFrame:
    """(request, source, slug) of the entry of that name: the preferred source first, then one called latest, then by source and name."""
    rows = wanted.withColumn("low", F.lower("request")).join(catalog.withColumn("low", F.lower("display_name")), "low")
    order = [F.desc(F.lower("source") == preferred.lower()), F.desc(F.lower("version") == "latest"), F.lower("source"), F.lower("display_name"), "slug"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where("place = 1").select("request", "source", "slug")


def sorted_listing(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in the order of columns, letter case aside."""
    return rows.orderBy(*[F.lower(b) for b in by], *by)


CACHE_ORDERS = {
    "newest": lambda: [F.desc_nulls_last("fetched_at")], "policy": lambda: [F.col("policy")], "largest": lambda: [F.desc("bytes")], "name": lambda: [F.col("source"), F.col("slug")],
}


def cache_view(entries: DataFrame, order: str = "name", source: str | None = None) -> DataFrame:
    """Cache entries of a source in one of CACHE_ORDERS, ties by source and slug."""
    rows = entries if source is None else entries.where(F.lower("source") == source.lower())
    return rows.orderBy(*CACHE_ORDERS[order](), "source", "slug", "cache_key")


def stale(catalogs: DataFrame, now: Column, days: int) -> DataFrame:
    return catalogs.where(F.col("fetched_at").isNull() | (F.datediff(now, F.col("fetched_at")) > days))


# Caches.


def cache_slug(key: Column, path: Column) -> Column:
    """The first part of the cache key; without a key the file's stem."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")
    return F.when(F.coalesce(key, F.lit("")) == "", F.regexp_replace(stem, r"\.meta", "")).otherwise(F.split_part(key, F.lit("/"), F.lit(1)))


def cache_source(path: Column, folders: dict[str, str]) -> Column:
    """The source whose folder is part of a path, in the order given; unknown without one."""
    parts = F.split(F.lower(path), "/")
    found = F.lit("unknown")
    for folder, source in reversed(folders.items()):
        found = F.when(F.array_contains(parts, folder), source).otherwise(found)
    return found


def cache_root(source: Column, slug: Column, folders: dict[str, tuple[str, bool]]) -> Column:
    """The folder of a cache entry: of its source (folder, whether slugs have folders), of all without a source, null for an unknown one."""
    root = F.when(source.isNull(), F.lit("."))
    for name, (folder, by_slug) in folders.items():
        inner = F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit(f"{folder}/"), slug)).otherwise(folder) if by_slug else F.lit(folder)
        root = root.when(F.lower(F.trim(source)) == name, inner)
    return root


def sidecars(files: DataFrame, source: Column, policy: Column) -> DataFrame:
    """(path, value): the metadata file to write beside each cached file (path, content), as JSON."""
    meta = F.struct(source.alias("source"), F.when(F.length("content") > 0, F.sha2("content", 256)).otherwise("").alias("checksum"), F.length("content").alias("byte_count"), policy.alias("policy"))
    return files.select(F.concat("path", F.lit(".meta.json")).alias("path"), F.to_json(meta).alias("value"))


def cache_counters(decisions: DataFrame, by: str) -> DataFrame:
    """(by, hits, refreshes)."""
    return decisions.groupBy(by).agg(F.count_if(~F.col("refresh")).alias("hits"), F.count_if("refresh").alias("refreshes"))


# Failures.


def failure(status: Column, timed_out: Column) -> Column:
    """struct(code, retriable, hint) of a failed request."""
    of = lambda code, retriable, hint: F.struct(F.lit(code).alias("code"), F.lit(retriable).alias("retriable"), F.lit(hint).alias("hint"))
    return (
        F.when(timed_out, of("network_timeout", True, "check the connection"))
        .when(status == 404, of("not_found", False, "removed or renamed at the source"))
        .when(status == 429, of("rate_limited", True, "wait a minute"))
        .otherwise(of("network_timeout", True, "check the connection"))
    )


def failure_row(kind: Column, message: Column) -> Column:
    """struct(code, message, retriable): an error by the name of its kind; a bare message is an unexpected error."""
    code = F.when(kind.isNull() | (kind == ""), "unexpected_error").otherwise(F.lower(F.regexp_replace(kind, "(?<=[a-z0-9])(?=[A-Z])", "_")))
    return F.struct(code.alias("code"), message.alias("message"), code.isin("network_timeout", "rate_limited", "timeout_error", "connection_error").alias("retriable"))


def display_text(message: Column, hint: Column) -> Column:
    return F.when(F.coalesce(hint, F.lit("")) != "", F.concat(message, F.lit(" "), hint)).otherwise(message)


# Checkpoints and jobs.


def checkpoint_state(events: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """(run, phase, emitted, position, last_slug, failures) from its events (run, seq, kind, phase, slug, order_hint).

    kind is phase, document or failure.  A document puts the run into compiling, a failure into failed.
    """
    phase = F.when(F.col("kind") == "document", "compiling").when(F.col("kind") == "failure", "failed").otherwise(F.col("phase"))
    document = F.col("kind") == "document"
    return events.groupBy(run).agg(
        F.max_by(phase, order).alias("phase"), F.count_if(document).alias("emitted"), F.max_by("order_hint", F.when(document, F.col(order))).alias("position"),
        F.max_by("slug", F.when(document, F.col(order))).alias("last_slug"), F.count_if(F.col("kind") == "failure").alias("failures"),
    )


def checkpoint_listing(checkpoints: DataFrame, now: Column, known: DataFrame) -> DataFrame:
    """(slug, phase, age_seconds, stale): stale are those of other schemas, and those whose slug no catalog has."""
    rows = checkpoints.join(known.select("slug", F.lit(True).alias("listed")).distinct(), "slug", "left")
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("updated_at"))
    return rows.select("slug", "phase", age.alias("age_seconds"), (F.col("listed").isNull() | (F.coalesce("schema_version", F.lit(0)) != 1)).alias("stale"))


def all_jobs(active: DataFrame, history: DataFrame, n: int = 100) -> DataFrame:
    """Active jobs and those of the history that aren't active, newest first."""
    past = history.join(active.select("job_id"), "job_id", "left_anti")
    return active.withColumn("active", F.lit(True)).unionByName(past.withColumn("active", F.lit(False))).orderBy(F.desc("created_at"), "job_id").limit(n)


def precedence(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key of either table: a column's value of the first, where it is null or blank that of the second."""
    one = first.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    two = second.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    merged = one.join(two, key, "full_outer")
    return merged.select(key, *[F.coalesce(F.nullif(F.trim(f"a_{c}"), F.lit("")), f"b_{c}").alias(c) for c in columns])


def event_lines(events: DataFrame, name: str, payload: list[str]) -> DataFrame:
    """(line): server-sent events, the payload as JSON."""
    return events.select(F.concat(F.lit("event: "), F.col(name), F.lit("\ndata: "), F.to_json(F.struct(*payload)), F.lit("\n\n")).alias("line"))
