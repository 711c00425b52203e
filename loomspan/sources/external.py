"""Sources of other formats: docsets, archives, JSON catalogs, JSON lines, rendered bundles."""

from __future__ import annotations

import glob
import io
import os
import sqlite3
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class DocsetSource(DataSource):
    """``docset``: the search index of SQLite docsets; option path is a glob, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "docset"

    def schema(self) -> str:
        return "docset string, pos int, name string, type string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _DocsetReader(self.options["path"])


class _DocsetReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for pos, row in enumerate(db.execute("select name, type, path from searchIndex order by type, name")):
                yield (os.path.basename(path), pos, *row)


class ArchiveSource(DataSource):
    """``archive``: text members of tar archives; options path (glob), suffix, prefix.  Absolute and climbing names and links are passed over."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], self.options.get("suffix", ""), self.options.get("prefix", ""))


class _ArchiveReader(DataSourceReader):
    def __init__(self, pattern: str, suffix: str, prefix: str):
        self.pattern, self.suffix, self.prefix = pattern, suffix, prefix

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with tarfile.open(partition.value) as tar:
            for member in tar:
                safe = member.isfile() and not member.name.startswith("/") and ".." not in member.name.split("/")
                if safe and member.name.endswith(self.suffix) and member.name.startswith(self.prefix):
                    body = tar.extractfile(member) or io.BytesIO()
                    yield os.path.basename(partition.value), member.name, body.read().decode("utf-8", "replace")


def register_sources(spark: SparkSession) -> None:
    for source in (DocsetSource, ArchiveSource):
        spark.dataSource.register(source)


def json_catalog(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of a JSON array with defaults: slug falls back to the lower-cased name, family to the slug's stem."""
    rows = spark.read.schema("name string, slug string, type string, release string, alias string, size bigint").option("multiLine", True).json(path)
    slug = F.coalesce(F.nullif("slug", F.lit("")), F.lower("name"))
    return rows.select(
        F.lit(source).alias("source"), slug.alias("slug"), F.coalesce(F.nullif("name", F.lit("")), slug).alias("display_name"), F.coalesce("release", F.lit("")).alias("version"),
        F.coalesce(F.nullif("type", F.lit("")), F.split_part(slug, F.lit("~"), F.lit(1))).alias("family"), F.array_compact(F.array("alias")).alias("aliases"), F.coalesce("size", F.lit(0)).alias("size_hint"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines file; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_with_corrupt(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each, with ``_corrupt_record`` where one does not parse."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())


def blob_map(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, html) of a JSON object of paths."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_key", "html"))


def bundle_documents(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(path, text) of a bundle's documents: no section pages, no consolidated file, no chunks, no site."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("file", F.input_file_name())
    path = F.regexp_replace("file", f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    rows = files.select(path.alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").rlike(r"(?:^|/)_section\.md$") & (F.col("path") != f"{language}.md") & ~F.col("path").rlike("(?:^|/)(?:chunks|_site)/"))


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All sources as one; columns that a source lacks are null."""
    whole = catalogs[0]
    for c in catalogs[1:]:
        whole = whole.unionByName(c, allowMissingColumns=True)
    return whole


def checked_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, valid) of cached files with a .meta.json beside them: checksum and size must be those of the file."""
    meta = spark.read.schema("checksum string, byte_count bigint").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(root)
    meta = meta.select(F.regexp_replace(F.input_file_name(), r"^file:/+|\.meta\.json$", "").alias("path"), "checksum", "byte_count")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~F.col("path").endswith(".meta.json"))
    files = files.select(F.regexp_replace("path", "^file:/+", "").alias("path"), F.sha2("content", 256).alias("sha"), "length")
    return meta.join(files, "path", "left").select("path", F.coalesce((F.col("sha") == F.col("checksum")) & (F.col("length") == F.col("byte_count")), F.lit(False)).alias("valid"))


def write_manifest(entries: DataFrame, path: str, source: str, strategy: str, fallback_reason: str = "") -> None:
    """A catalog manifest: one JSON object an entry, with the source, how it was discovered, when, and why a fallback was used."""
    head = {"source": source, "discovery_strategy": strategy, "fallback_reason": fallback_reason}
    rows = entries.select("*", *[F.lit(v).alias(f"manifest_{k}") for k, v in head.items()], F.current_timestamp().alias("manifest_fetched_at"))
    rows.write.mode("overwrite").json(path)  # the commit protocol moves files into place when all are written


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest but for ignored ones; a missing support level is supported."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    level = F.coalesce(F.nullif("support_level", F.lit("")), F.lit("supported"))
    return rows.withColumn("support_level", level).where("support_level <> 'ignored'")


CHECKPOINT_VERSION = 1


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(slug, phase, emitted_document_count, document_inventory_position, updated_at, file) of checkpoint files of this schema version; others and broken ones are left out."""
    rows = json_with_corrupt(spark, path, "schema_version int, slug string, phase string, emitted_document_count bigint, document_inventory_position bigint, updated_at string")
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("schema_version") == CHECKPOINT_VERSION)).drop("_corrupt_record", "schema_version")


def cache_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, cache_key, policy, byte_count, raw) of all sidecars; those that don't parse are kept with their text as raw."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*meta.json").text(root, wholetext=True).withColumn("path", F.input_file_name())
    meta = F.from_json("value", "source string, cache_key string, policy string, byte_count bigint, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.select("path", meta.alias("m"), "value")
    return rows.select("path", "m.source", "m.cache_key", "m.policy", "m.byte_count", F.when(F.col("m._corrupt_record").isNotNull(), F.col("value")).alias("raw"))


def _json_or_none(spark: SparkSession, path: str) -> str | None:
    """The text of one small file of the driver's own configuration."""
    from ..storage import exists

    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None


def settings(spark: SparkSession, defaults: dict[str, str], path: str) -> dict[str, str]:
    """Defaults overlaid by a file of one JSON object; a missing or broken file leaves them."""
    text = _json_or_none(spark, path)
    given = spark.range(1).select(F.from_json(F.lit(text), "map<string,string>")).first()[0] if text else None
    return {**defaults, **(given or {})}


def corpus_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a corpus file: a list, or an object with languages; names are texts or objects with a name."""
    import json

    found = json.loads(_json_or_none(spark, path) or "[]")
    return [x if isinstance(x, str) else x["name"] for x in (found if isinstance(found, list) else found.get("languages", []))]
