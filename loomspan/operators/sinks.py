"""Sinks of bundles: document files, chunks, site, book, reports, templates."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compile import ordered_text


_TYPE = "application"
_OASIS = "urn:oasis:names:tc:opendocument:xmlns"
_OPF = "/".join(["http://www.idpf.org", "2007", "opf"])


def write_documents(docs: DataFrame, path: str, *partition: str) -> None:
    """Rendered documents by bundle and topic; a bundle that is written again replaces its own partitions only."""
    docs.write.option("partitionOverwriteMode", "dynamic").partitionBy(*partition).mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def template_opening(template: str) -> str:
    return "# Contents\n\n" if template == "detailed" else ""


def template_pieces(docs: DataFrame, bundle: str, title: str, body: str, order: str, template: str = "default") -> DataFrame:
    """(bundle, section, key, pos, piece, separator): what a page is joined from, each piece with what separates it from the one before."""
    head = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body))
    key = F.lower(title) if template == "api-reference" else F.lit("")
    of = lambda section, piece, separator: F.struct(F.lit(section).alias("section"), piece.alias("piece"), F.lit(separator).alias("separator"))
    parts = [of(1, F.col(body) if template == "minimal" else head, "\n\n")]
    if template == "detailed":
        parts = [of(0, F.concat(F.lit("- "), F.col(title)), "\n"), *parts]
    return docs.select(F.col(bundle), key.alias("key"), F.col(order).alias("pos"), F.inline(F.array(*parts)))


def templated(docs: DataFrame, bundle: str, title: str, body: str, order: str, template: str = "default") -> DataFrame:
    """(bundle, page): default joins bodies under titles, minimal bodies, detailed adds a contents list, api-reference sorts by title.  A page is one value here; template_pieces has it of any length."""
    pieces = template_pieces(docs, bundle, title, body, order, template)
    page = ordered_text(F.concat("separator", "piece"), F.struct("section", "key", "pos"), "")
    return pieces.groupBy(bundle).agg(F.concat(F.lit(template_opening(template)), F.regexp_replace(page, r"\A\n" if template == "detailed" else r"\A\n\n", "")).alias("page"))


def escaped_html(text: Column) -> Column:
    """Markdown as preformatted HTML, the form used where no renderer is installed."""
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return F.concat(F.lit("<pre>"), out, F.lit("</pre>"))


def site(docs: DataFrame, bundle: str, title: str, path: str, body: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(pages (bundle, path, html), index (bundle, html))."""
    shell = lambda head, inner: F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), head, F.lit("</title>"), inner)
    pages = docs.select(bundle, F.regexp_replace(path, r"\.md$", ".html").alias("path"), shell(F.col(title), escaped_html(F.col(body))).alias("html"))
    item = F.concat(F.lit('<li><a href="'), F.regexp_replace(path, r"\.md$", ".html"), F.lit('">'), F.col(title), F.lit("</a></li>"))
    index = docs.groupBy(bundle).agg(F.concat(F.lit("<ul>"), ordered_text(item, F.col(order), ""), F.lit("</ul>")).alias("html"))
    return pages, index


def _xml(tag: str, children: list, **attributes: str):
    node = ElementTree.Element(tag, {k.replace("_", "-"): v for k, v in attributes.items()})
    node.extend(children)
    return node


def write_book(pages: DataFrame, path: str, title: str, order: str = "path") -> int:
    """An EPUB of one bundle's pages (path, html); rows come to the driver one partition at a time, and the file is written as they come."""
    as_text = lambda node: ElementTree.tostring(node, encoding="unicode", xml_declaration=True)
    root = _xml("rootfile", [], full_path="content.opf", media_type=f"{_TYPE}/oebps-package+xml")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(zipfile.ZipInfo("mimetype"), f"{_TYPE}/epub+zip")
        book.writestr("META-INF/container.xml", as_text(_xml("container", [_xml("rootfiles", [root])], version="1.0", xmlns=f"{_OASIS}:container")))
        names = []
        for row in pages.orderBy(order).toLocalIterator():
            names.append(f"p{len(names):05d}.xhtml")
            book.writestr(names[-1], row["html"])
        heading = _xml("title", [])
        heading.text = title
        items = [_xml("item", [], id=f"i{i}", href=n, media_type=f"{_TYPE}/xhtml+xml") for i, n in enumerate(names)]
        spine = [_xml("itemref", [], idref=f"i{i}") for i in range(len(names))]
        package = _xml("package", [_xml("metadata", [heading]), _xml("manifest", items), _xml("spine", spine)], version="3.0", xmlns=_OPF)
        book.writestr("content.opf", as_text(package))
    return len(names)


def run_report(rows: DataFrame, by: str) -> DataFrame:
    """(by, report): runs of (name, documents, score, seconds) as Markdown tables."""
    line = F.concat_ws(" | ", "name", F.col("documents").cast("string"), F.format_string("%.2f", "score"), F.format_string("%.1f", "seconds"))
    table = ordered_text(F.concat(F.lit("| "), line, F.lit(" |")), F.col("name"), "\n")
    return rows.groupBy(by).agg(F.concat(F.lit("| name | documents | score | seconds |\n| --- | --- | --- | --- |\n"), table).alias("report"))


def chunk_records(chunks: DataFrame, language: Column, topic: Column, slug: Column) -> DataFrame:
    """Chunk rows with their id and path; totals count all chunks of a slug."""
    number = F.lpad(F.col("chunk_index").cast("string"), 4, "0")
    total = F.count(F.lit(1)).over(Window.partitionBy("document_slug"))
    return (
        chunks.withColumn("document_slug", slug)
        .withColumn("chunk_id", F.concat_ws(":", language, topic, slug, number))
        .withColumn("text_path", F.concat(F.lit("chunks/"), topic, F.lit("-"), slug, F.lit("-"), number, F.lit(".md")))
        .withColumn("chunk_total", total)
    )


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(suffix.isin(".md", ".markdown"), "text/markdown").when(suffix == ".json", "application/json").when(suffix.isin(".html", ".htm"), "text/html").when(suffix == ".txt", "text/plain").otherwise("application/octet-stream")


def inside(root: str, path: Column) -> Column:
    """Whether a relative path stays under its root."""
    parts = F.split(path, "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, p: F.struct(
        (s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
        F.least(s["low"], s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
    ))
    return ~F.startswith(path, F.lit("/")) & (depth["low"] >= 0)


def find_next(text: Column, wanted: str, position: Column) -> Column:
    """1-based place of the next occurrence behind a position, from the start again if there is none; 0 if it never occurs."""
    low = F.lower(text)
    ahead = F.call_function("locate", F.lit(wanted.lower()), low, position + 1)
    return F.when(ahead > 0, ahead).otherwise(F.call_function("locate", F.lit(wanted.lower()), low))


def staleness(checkpoints: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Checkpoints (source, slug, inside_root) with the reason they are stale, if any."""
    known = catalogs.select(F.lower("source").alias("_s"), F.col("slug").alias("_g")).distinct().withColumn("_known", F.lit(True))
    sources = catalogs.select(F.lower("source").alias("_s2")).distinct().withColumn("_source", F.lit(True))
    rows = checkpoints.join(known, (F.lower("source") == F.col("_s")) & (F.col("slug") == F.col("_g")), "left").join(sources, F.lower("source") == F.col("_s2"), "left")
    reason = F.when(~F.col("inside_root"), "path_outside").when(F.col("_source").isNull(), "catalog_missing").when(F.col("_known").isNull(), "slug_unresolved")
    return rows.withColumn("reason", reason).select(*checkpoints.columns, "reason")
