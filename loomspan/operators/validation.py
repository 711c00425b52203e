"""Validation of bundles: issues, weights, component scores and the composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markdown as M

#: code: (level, weight, component)
RULES = {
    "missing_output": ("error", 1.0, "completeness"), "no_documents": ("error", 1.0, "completeness"), "tiny_output": ("error", 0.8, "completeness"),
    "missing_section": ("warning", 0.45, "completeness"), "no_topics": ("warning", 0.35, "completeness"),
    "code_fence": ("warning", 0.35, "structure"), "missing_internal_anchor": ("warning", 0.3, "structure"), "duplicate_topic_section": ("warning", 0.3, "structure"),
    "document_heading_count_mismatch": ("warning", 0.45, "structure"), "malformed_heading_hierarchy": ("warning", 0.5, "structure"), "duplicate_document_heading": ("warning", 0.25, "structure"),
    "relative_link": ("warning", 0.35, "conversion"), "relative_image": ("warning", 0.2, "conversion"), "empty_link_target": ("warning", 0.2, "conversion"),
    "html_artifact": ("warning", 0.35, "conversion"), "malformed_table": ("warning", 0.3, "conversion"), "definition_list_artifact": ("warning", 0.2, "conversion"),
    "topic_total_mismatch": ("warning", 0.45, "consistency"), "source_inventory_mismatch": ("warning", 0.4, "consistency"), "emitted_less_than_compiled": ("warning", 0.55, "consistency"),
}
COMPONENTS = dict(completeness=0.35, structure=0.25, conversion=0.15, consistency=0.15, document_quality=0.10)


def penalty(code: Column, level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c, (_, w, _) in RULES.items() for x in (c, w)])
    return F.coalesce(F.element_at(table, code), F.when(level == "error", 0.7).when(level == "warning", 0.25).otherwise(0.1))


def bundle_scale(documents: Column, topics: Column) -> Column:
    root = lambda x: F.sqrt(F.greatest(x - 1, F.lit(0)).cast("double"))
    return 1 + F.least(F.lit(1.6), root(documents) * 0.18 + root(topics) * 0.08)


def document_scale(documents: Column) -> Column:
    return 1 + F.least(F.lit(1.8), F.sqrt(F.greatest(documents - 1, F.lit(0)).cast("double")) * 0.22)


def component_scores(issues: DataFrame, bundles: DataFrame, bundle: str) -> DataFrame:
    """(bundle, completeness, structure, conversion, consistency, document_quality, score).

    issues are (bundle, scope, level, code); scope is 'bundle' or 'document'.  bundles are (bundle, documents, topics).
    """
    table = F.create_map(*[F.lit(x) for c, (_, _, part) in RULES.items() for x in (c, part)])
    part = F.when(F.col("scope") == "document", "document_quality").otherwise(F.element_at(table, F.col("code")))
    sums = issues.withColumn("part", part).withColumn("w", penalty(F.col("code"), F.col("level"))).groupBy(bundle).agg(*[F.sum(F.when(F.col("part") == c, F.col("w"))).alias(c) for c in COMPONENTS])
    rows = bundles.join(sums, bundle, "left")
    scale = bundle_scale(F.col("documents"), F.col("topics"))
    scales = {"completeness": scale, "structure": F.greatest(F.lit(1.0), scale * 0.95), "conversion": scale * 1.1, "consistency": scale, "document_quality": document_scale(F.col("documents"))}
    each = {c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.col(c), F.lit(0.0)) / s)), 2).cast("double") for c, s in scales.items()}
    rows = rows.select(bundle, *[e.alias(c) for c, e in each.items()])
    total = F.lit(0.0)
    for c, w in COMPONENTS.items():
        total = total + F.col(c) * w
    return rows.withColumn("score", total)


def document_quality(issues: DataFrame, *document: str) -> DataFrame:
    """(document, n_issues, quality) of the documents that have issues."""
    counts = issues.groupBy(*document).agg(F.count(F.lit(1)).alias("n_issues"))
    return counts.withColumn("quality", F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(0.95), F.col("n_issues") * 0.12)), 2))


def inventory_issues(rows: DataFrame, bundle: str) -> DataFrame:
    """Issues of bundles (documents, topic_documents, discovered, emitted, skipped) that do not add up."""
    codes = F.array_compact(F.array(
        F.when(F.col("topic_documents") != F.col("documents"), F.lit("topic_total_mismatch")),
        F.when(F.col("emitted") + F.col("skipped") < F.col("discovered"), F.lit("source_inventory_mismatch")),
        F.when(F.col("emitted") < F.col("documents"), F.lit("emitted_less_than_compiled")),
    ))
    return rows.select(bundle, F.explode(codes).alias("code"))


SECTIONS = ("## Metadata", "## Table of Contents", "## Documentation")


def _once(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def output_codes(text: Column, documents: Column, n_topics: Column, sections: tuple[str, ...] = SECTIONS) -> Column:
    """Codes of a consolidated text: size, fences, sections, topics; missing_output alone where there is none."""
    missing = [_once(~F.contains(text, F.lit(s)), "missing_section") for s in sections]
    codes = F.array(_once(documents == 0, "no_documents"), _once(F.length(text) < 2000, "tiny_output"), _once(F.regexp_count(text, F.lit("```")) % 2 == 1, "code_fence"), *missing, _once(n_topics == 0, "no_topics"))
    return F.when(text.isNull(), F.array(F.lit("missing_output"))).otherwise(F.array_compact(codes))


def output_issues(rows: DataFrame, bundle: str, text: str, sections: list[str]) -> DataFrame:
    """Issues of consolidated texts with (documents, topics): size, fences, sections, topics."""
    return rows.select(bundle, F.posexplode(output_codes(F.col(text), F.col("documents"), F.col("topics"), tuple(sections))).alias("n", "code"))


def link_codes(links: Column) -> Column:
    """Codes of links, images and empty targets, once each."""
    return F.array_compact(F.array_distinct(F.transform(links, lambda x: M.link_code(x["image"], x["target"]))))


def anchor_codes(text: Column, links: Column) -> Column:
    """missing_internal_anchor where a link names an anchor that the text lacks."""
    own = F.regexp_extract_all(text, F.lit(M.ANCHOR), F.lit(1))
    t = lambda x: F.trim(x["target"])
    wanted = F.filter(links, lambda x: ~x["image"] & F.startswith(t(x), F.lit("#")) & (t(x) != "#"))
    missing = F.array_except(F.transform(wanted, lambda x: F.substr(t(x), F.lit(2))), own)
    return F.array_compact(F.array(_once(F.size(missing) > 0, "missing_internal_anchor")))


def conversion_codes(parts: Column, prose: Column) -> Column:
    html, defined = F.exists(prose, lambda line: line.rlike(M.LEFT_OVER_TAG)), F.exists(prose, lambda line: line.rlike(M.DEFINITION))
    return F.array_compact(F.array(_once(html, "html_artifact"), _once(F.size(M.table_runs(parts)) > 0, "malformed_table"), _once(defined, "definition_list_artifact")))


def structure_codes(text: Column, topics: Column, documents: Column) -> Column:
    """Topic sections and document headings of the documentation part, code not spared."""
    at = F.locate("## Documentation", text)
    body = F.when(at > 0, F.substr(text, at))
    titles = F.regexp_extract_all(body, F.lit(r"(?m)^###[ \t]+(\S(?:.*\S)?)[ \t]*$"), F.lit(1))
    twice = F.filter(topics, lambda t: F.size(F.filter(titles, lambda x: x == t)) > 1)
    heads = F.regexp_count(body, F.lit(r"(?m)^####[ \t]+\S"))
    first = F.regexp_extract(body, r"(?m)^(###|####)[ \t]+\S", 1)
    parts = F.filter(F.split(body, r"(?m)^###(?=[ \t])"), lambda _, i: i > 0)  # what stands before the first topic is left out
    pairs = F.flatten(F.transform(parts, lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(r"(?m)^####[ \t]+(\S(?:.*\S)?)[ \t]*$"), F.lit(1)), lambda title: F.concat(F.trim(F.substring_index(p, "\n", 1)), F.lit("\u0000"), title))))
    return F.when(body.isNull(), F.array().cast("array<string>")).otherwise(F.concat(
        F.transform(twice, lambda _: F.lit("duplicate_topic_section")),
        F.array_compact(F.array(
            _once((documents > 0) & ((F.size(titles) > 0) | (heads > 0)) & (heads != documents), "document_heading_count_mismatch"),
            _once(first == "####", "malformed_heading_hierarchy"), _once(F.size(F.array_distinct(pairs)) < F.size(pairs), "duplicate_document_heading"),
        )),
    ))


def inventory_codes(documents: Column, topic_documents: Column, discovered: Column, emitted: Column, skipped: Column) -> Column:
    """Codes of counts that do not add up; none where the source gave no counts."""
    codes = F.array(
        _once(topic_documents != documents, "topic_total_mismatch"), _once((discovered > 0) & (emitted + skipped < discovered), "source_inventory_mismatch"), _once(emitted < documents, "emitted_less_than_compiled"),
    )
    return F.when(emitted.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(codes))


def bundle_issues(bundles: DataFrame, bundle: str = "bundle") -> DataFrame:
    """(bundle, level, code) of bundles (text, topics array<string>, documents, topic_documents, discovered, emitted, skipped).

    One pass over each text, without a shuffle; a null text is a missing output and has no other issue.
    """
    c = F.col
    codes = F.concat(
        output_codes(c("text"), c("documents"), F.size("topics")), link_codes(c("md_links")), anchor_codes(c("text"), c("md_links")), structure_codes(c("text"), c("topics"), c("documents")),
        inventory_codes(c("documents"), c("topic_documents"), c("discovered"), c("emitted"), c("skipped")), conversion_codes(c("md_parts"), c("md_prose")),
    )
    codes = F.when(c("text").isNull(), F.array(F.lit("missing_output"))).otherwise(codes)
    return M.parsed(bundles).select(bundle, F.explode(codes).alias("code")).select(bundle, _level("code"), "code")


def _level(code: str) -> Column:
    errors = [c for c, (level, _, _) in RULES.items() if level == "error"]
    return F.when(F.col(code).isin(errors), "error").otherwise("warning").alias("level")


def resolved_path(folder: Column, target: Column) -> Column:
    """The path that a relative link in a folder leads to; null where it leaves the root."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), target), "/"), lambda x: ~x.isin("", "."))
    up = lambda at: F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))  # noqa: E731  (null for good once it is left)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda at, x: F.when(x == "..", up(at)).otherwise(F.concat(at, F.array(x))))
    return F.when(~F.startswith(target, F.lit("/")), F.array_join(walked, "/"))


def anchors_of(text: Column) -> Column:
    """What a link may name in a text: its explicit anchors and slugs of its headings (letters, digits and dashes only)."""
    explicit = F.transform(F.regexp_extract_all(text, F.lit(M.ANCHOR), F.lit(1)), lambda x: F.lower(F.trim(x)))
    titles = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(\S(?:.*\S)?)[ \t]*$"), F.lit(1))
    slugs = F.transform(titles, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\\-]", ""), "^-+|-+$", ""))
    return F.array_union(explicit, slugs)


def document_issues(files: DataFrame) -> DataFrame:
    """(bundle, path, level, code) of rendered documents (bundle, path, text), path relative to the bundle's root.

    Links to other documents are one join of link targets with the files' anchors; a topic's section page is the file _section.md.
    """
    paths = files.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    docs = paths.where("name <> '_section.md'")
    read = M.parsed(docs)
    own = read.select("bundle", "path", F.explode(F.concat(link_codes(F.col("md_links")), conversion_codes(F.col("md_parts"), F.col("md_prose")))).alias("code"))
    linked = read.select("bundle", "path", "folder", anchors_of(F.col("text")).alias("own"), F.explode("md_links").alias("l"))
    raw = F.trim("l.target")
    linked = linked.where(~F.col("l.image") & (raw != "") & ~raw.rlike("^(?:https?://|mailto:|tel:|dash://|data:)"))
    parts = linked.select("bundle", "path", "folder", "own", F.split(raw, "#", 2).alias("p")).select(
        "bundle", "path", "own", F.get("p", 0).alias("rel"), F.lower(F.trim(F.coalesce(F.get("p", 1), F.lit("")))).alias("anchor"), resolved_path(F.col("folder"), F.get("p", 0)).alias("to"),
    )
    targets = files.select("bundle", F.col("path").alias("to"), anchors_of(F.col("text")).alias("theirs"))
    there = parts.where("rel <> ''").join(targets, ["bundle", "to"], "left")
    broken = there.where(F.col("theirs").isNull() | ((F.col("anchor") != "") & ~F.array_contains("theirs", F.col("anchor")))).select("bundle", "path")
    here = parts.where((F.col("rel") == "") & (F.col("anchor") != "") & ~F.array_contains("own", F.col("anchor"))).select("bundle", "path")
    broken = broken.unionByName(here).withColumn("code", F.lit("broken_internal_link"))
    sections = paths.where("name = '_section.md'").select("bundle", "folder", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)]+\.md)\)"), F.lit(1))).alias("name"))
    twice = sections.groupBy("bundle", "folder", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = docs.join(twice, ["bundle", "folder", "name"], "left_semi").select("bundle", "path", F.lit("duplicate_section_link").alias("code"))
    whole = own.unionByName(broken).unionByName(repeated)
    return whole.select("bundle", "path", _level("code"), "code")
