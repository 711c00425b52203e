"""Golden tables and properties of the engine's own operators."""

import io
import json
import re
import sqlite3
import tarfile
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan import registry
from loomspan.functions import html, url
from loomspan.functions import text as T
from loomspan.operators import catalog, chunking, ingest, jobs, query, search
from loomspan.operators import compile as compiling
from loomspan.operators import markdown as M
from loomspan.plans.catalogs import fixture_catalog
from loomspan.sources import external


def values(spark, column, items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_slugs(spark):
    cases = {"std::vector": "std-vector", "file.name": "file-name", "CON": "con-item", "aux": "aux-item", "Ünï cödé": "uni-code", "": "document", "---": "document"}
    assert values(spark, T.slugify, list(cases)) == list(cases.values())


def test_language_names(spark):
    cases = {"Node.js": "nodejs", "node 20": "nodejs20", "py 3.12": "python312", "C＋＋": "cpp", ".NET": "net", "C#": "csharp"}
    assert values(spark, T.normalise_language, list(cases)) == list(cases.values())


def test_resolution(spark):
    wanted = spark.createDataFrame([(x,) for x in ("py", "js", "python 3.12", "vue 3", ".NET", "cobol")], "request string")
    got = {r["request"]: (r["source"], r["slug"]) for r in catalog.resolve(catalog.with_terms(fixture_catalog(spark)), wanted).collect()}
    assert got == {
        "py": ("hub", "python~3.13"), "js": ("archive", "javascript"), "python 3.12": ("hub", "python~3.12"), "vue 3": ("docset", "Vue"), ".NET": ("hub", "net"), "cobol": (None, None),
    }


def test_unique_slugs_pass_over_taken_names(spark):
    rows = spark.createDataFrame([("t", "a", 1), ("t", "a-2", 2), ("t", "a", 3), ("t", "a", 4), ("u", "b", 5), ("u", "b", 6)], "topic string, slug string, pos int")
    got = {r["pos"]: r["final_slug"] for r in compiling.unique_slugs(rows, "topic", "slug", "pos").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-3", 4: "a-4", 5: "b", 6: "b-2"}


def test_scan_reasons(spark):
    rows = spark.createDataFrame(
        [(1, "a", "Reference", "x"), (2, "a", "Reference", "y"), (3, "b", "Guide", "x"), (4, "c", "Reference", None), (5, "c", "Reference", "z"), (6, "", "Reference", "z"), (7, "d", "reference", " ")],
        "pos int, path string, topic string, content string",
    )
    got = ingest.scan_reasons(rows, key="path", order="pos", topic="topic", content="content", mode="important", core=["Reference"])
    assert {r["pos"]: r["skip_reason"] for r in got.collect()} == {
        1: None, 2: "duplicate_path", 3: "filtered_mode", 4: "missing_content", 5: "duplicate_path", 6: "missing_path_or_type", 7: "empty_markdown",
    }


def test_controller():
    ok, bad = {}, {"failures": 1}
    assert jobs.concurrency_trace([ok, ok], 1, 1, 3)[-1] == 2
    assert jobs.concurrency_trace([{"retries": 4, "failures": 1}], 3, 1, 6) == [2]
    assert jobs.concurrency_trace([bad, bad], 5, 2, 3) == [2, 2]
    assert jobs.concurrency_trace([{"memory": True}], 4, 2, 6) == [1]


def test_bm25_against_sqlite(spark):
    rows = [(1, "alpha ref alpha beta gamma"), (2, "beta ref beta beta delta epsilon zeta"), (3, "gamma g gamma gamma"), (4, "x g nothing here at all"), (5, "y g more filler words")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body)")
    db.executemany("insert into f(rowid, body) values (?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for term in ("beta", "gamma", "delta"):
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (term,)))
        got = {r["doc_id"]: r["score"] for r in search.bm25(docs, [term]).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_query_grammar():
    found = query.parse('a "b c" d* OR NEAR(e f) NOT g')
    assert found.kind == "or" and [x.kind for x in query.leaves(found)] == ["term", "phrase", "prefix", "near", "term"]
    assert query.parse("x NOT y") == query.Node("not", (query.Leaf("term", ("x",)), query.Leaf("term", ("y",)))) and query.parse("  ") is None
    for wrong in ("C++", "foo(", "node.js"):
        with pytest.raises(ValueError, match="syntax"):
            query.parse(wrong)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=3000), st.integers(500, 900), st.integers(0, 900))
def test_char_chunks_cover_the_text(text, size, overlap):
    spans = chunking.char_chunks(text, size, overlap)
    assert bool(spans) == bool(text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= size for a, b in spans)
        assert all(c <= b and c > a for (a, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_semantic_chunks_keep_fences_and_parents():
    text = "## Parent\n\nintro\n### Child One\n```\n## not a heading\n```\n" + "x" * 900 + "\n### Child Two\nbody\n"
    chunks = chunking.semantic_chunks(text, 500)
    assert len(chunks) > 1 and all(c["text"].count("```") % 2 == 0 for c in chunks)
    assert chunks[-1]["text"].startswith("## Parent\n\n### Child Two")
    assert chunking.heading_context(chunks[-1]["text"]) == ("Parent", "Child Two")


def test_html_to_markdown():
    page = "<html><nav>no</nav><main><h1>Title</h1><p>One <b>two</b><p>Three<ul><li>a<ul><li>b</ul><li>c</ul><pre>x = 1\n</pre><table><tr><th>A<th>B<tr><td>1<td>2</table><a href='/x'>l</a></main></html>"
    text, selector = html.to_markdown(page, "https://e.org/d/")
    assert selector == "main" and "no" not in text.split()
    for part in ("# Title", "One **two**", "Three", "* a\n  * b\n* c", "```\nx = 1\n```", "| A | B |\n| --- | --- |\n| 1 | 2 |", "[l](https://e.org/x)"):
        assert part in text
    assert [t for t, _ in html.sections("<main><h2>A</h2>x<h2>B</h2>y</main>")] == ["A", "B"]


def test_urls():
    assert url.normalised("HTTP://Ex.org:443/a//b/../index.html?b=2&utm_source=x&A=1#f") == "https://ex.org/a?a=1&b=2"
    assert url.resolved("b c.html", "dash://set/a/x.html") == "dash://set/a/b c.html"
    assert url.resolved("#t", "https://e.org") == "#t" and url.resolved("../y", "https://e.org/a/b/c") == "https://e.org/a/y"


def test_markdown_rules(spark):
    text = "# T\n[a](#gone) [b](#here) `[c](x.md)`\n<a id=\"here\"></a>\n```\n[d](y.md)\n```\n[e](z.md) ![f](p.png) [g]()\n| a | b |\n| --- | --- |\n| c |\n<div>\n: def\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    assert [(r["doc_id"], r["anchor"]) for r in M.broken_anchors(docs).collect()] == [(1, "gone")]
    assert {r["code"]: r["n"] for r in M.link_problems(docs).collect()} == {"relative_link": 1, "relative_image": 1, "empty_link_target": 1}
    assert M.malformed_tables(docs).count() == 1 and {r["code"] for r in M.artefacts(docs).collect()} == {"html_artifact", "definition_list_artifact"}


def test_sources(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.dsidx") as db:
        db.execute("create table searchIndex(name text, type text, path text)")
        db.executemany("insert into searchIndex values (?, ?, ?)", [("beta", "Reference", "m.html#b"), ("alpha", "Guide", "g.html")])
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        for name, body in (("files/x/index.md", b"one"), ("files/y/other.txt", b"no"), ("../up/index.md", b"bad")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    (tmp_path / "catalog.json").write_text(json.dumps([{"name": "Python", "slug": "python~3.12", "release": "3.12"}, {"name": "Go"}]))
    external.register_sources(spark)
    assert [r["name"] for r in spark.read.format("docset").load(str(tmp_path / "*.dsidx")).orderBy("pos").collect()] == ["alpha", "beta"]
    assert [r["member"] for r in spark.read.format("archive").option("suffix", "/index.md").load(str(tmp_path / "*.tar.gz")).collect()] == ["files/x/index.md"]
    assert sorted(r["a"] for r in external.json_lines(spark, str(tmp_path / "rows.jsonl"), "a int").collect()) == [1, 2]
    got = {r["slug"]: r["family"] for r in external.json_catalog(spark, str(tmp_path / "catalog.json"), "hub").collect()}
    assert got == {"python~3.12": "python", "go": "go"}


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, "lang", f"topic{i % 3}", f"Doc {i % 4}") for i in range(40)], "doc_id bigint, lang string, source string, title string")
    run = lambda d: sorted(map(tuple, compiling.anchor_registry(d, "lang", "source", "title", "doc_id").collect()))
    assert run(rows.repartition(1)) == run(rows.repartition(7))


def test_entry_contract(spark):
    import __spark_entry__ as e

    names, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 90
    assert e.entry(spark).columns == ["doc_id", "score"]


def test_book(spark, tmp_path):
    import zipfile

    from loomspan.operators import sinks

    pages = spark.createDataFrame([("b.html", "<p>two</p>"), ("a.html", "<p>one</p>")], "path string, html string")
    assert sinks.write_book(pages, str(tmp_path / "x.epub"), "A & B") == 2
    with zipfile.ZipFile(tmp_path / "x.epub") as book:
        assert book.namelist()[0] == "mimetype" and book.read("p00000.xhtml") == b"<p>one</p>"
        assert b"A &amp; B" in book.read("content.opf") and b'idref="i1"' in book.read("content.opf")


def test_front_matter(spark):
    from loomspan.functions import frontmatter

    pytest.importorskip("yaml")
    pages = ["---\ntitle: A\npage-type: [x, y]\n---\n\n# Body\n", "---\ntitle: [broken\n---\nrest", "plain", None]
    rows = [r["p"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, raw string").orderBy("i").select(frontmatter.parse(F.col("raw")).alias("p")).collect()]
    assert json.loads(rows[0]["meta"]) == {"title": "A", "page-type": ["x", "y"]} and rows[0]["body"] == "# Body\n"
    assert rows[1]["body"] == pages[1] and rows[1]["warning"].startswith("malformed_frontmatter") and rows[2]["body"] == "plain"
    page = spark.range(1).select(frontmatter.with_head(F.create_map(F.lit("title"), F.lit('say "hi": now')), F.lit("b")).alias("x")).first()["x"]
    assert json.loads(frontmatter.split_page(page)[0]) == {"title": 'say "hi": now'} and frontmatter.split_page(page)[1] == "b"


def test_sidecars(spark, tmp_path):
    import hashlib

    for name, body, wrong in (("a.json", b"one", False), ("b.json", b"two", True)):
        (tmp_path / name).write_bytes(body)
        (tmp_path / f"{name}.meta.json").write_text(json.dumps({"checksum": hashlib.sha256(body).hexdigest(), "byte_count": len(body) + wrong}))
    got = {r["path"].rsplit("/", 1)[-1]: r["valid"] for r in external.checked_sidecars(spark, str(tmp_path)).collect()}
    assert got == {"a.json": True, "b.json": False}


def test_cross_references_cover_every_language(spark, tmp_path):
    texts = [
        (1, "The Version of HttpClient", "en"), (2, "Die Version für HttpClient, größeWert und read_file", "de"), (3, "La Version, été Élan read_file()", "fr"),
        (4, "Sin idioma: Version read_file", None), (5, None, "es"), (6, "nada aquí", "es"),
    ]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pattern = r"\b([A-Z][0-9A-Za-z]+|[a-z]+_[_0-9a-z]+|[_A-Za-z][_0-9A-Za-z]*\(\))\b"
    ids = {d: [x for x in dict.fromkeys(re.findall(pattern, t or "")) if len(x) >= 3] for d, t, _ in texts}
    run = lambda name: [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(run("xref_index")) == sorted((x, d) for d, found in ids.items() for x in found)
    assert {(lang, n, tuple(docs)) for lang, n, docs in run("xref_lookup")} == {("en", 1, (1,)), ("de", 1, (2,)), ("fr", 1, (3,)), (None, 1, (4,))}
    assert {(a, b) for a, b, _ in run("related_docs")} == {(a, b) for a in ids for b in ids if a != b and set(ids[a]) & set(ids[b])}


def test_sizes_of_every_unit(spark, tmp_path):
    sizes = [0, 1023, 1024, 1536, 999_999, 1_000_000, 1 << 20, 5 << 20, 3 << 29, 7 << 30, 3 << 40, 5000 << 40, None]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(n):
        power = 0
        while n is not None and power < 4 and n >= 1024 ** (power + 1):
            power += 1
        return None if n is None else f"{n} B" if not power else f"{n / 1024**power:.1f} {('KB', 'MB', 'GB', 'TB')[power - 1]}"

    got = {r["doc_id"]: r["size"] for r in registry.queries()["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(n) for i, n in enumerate(sizes)}


def test_slugs_of_whole_texts(spark, tmp_path):
    texts = ["Ünï cödé " * 20 + "Ende: größe", "a" * 39 + " é b", "aux", "", None, "--- " * 30 + "É"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        slug = re.sub("[^0-9a-z]+", "-", plain.lower()).strip("-") or "document"
        return f"{slug}-item" if slug == "aux" else slug

    got = {r["doc_id"]: r["slug"] for r in registry.queries()["slugify_unicode"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}
