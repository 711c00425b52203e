"""What must hold however large a table is, on small tables cut into many slices."""

import hashlib
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.frames import in_pieces
from loomspan.functions import text
from loomspan.operators import adapters, catalog, chunking, digest, readmodels, sinks
from loomspan.operators import compile as compiling
from loomspan.operators import index as stored
from loomspan.storage import exists, scratch

TEXTS = [(g, i, f"{g} é text {i} " * (i % 5)) for g in ("a", "b", None) for i in range(120 if g != "b" else 3)]


@pytest.mark.parametrize("slice_bytes, library", [(1 << 20, True), (1500, True), (1500, False)])
def test_a_joined_text_is_hashed_slice_by_slice(spark, monkeypatch, slice_bytes, library):
    if not library:
        monkeypatch.setattr(digest, "_library", lambda: None)
    elif digest._library() is None:
        pytest.skip("no library whose hash can be set aside")
    rows = spark.createDataFrame(TEXTS + [("a", 999, None)], "g string, i int, t string").repartition(3)
    got = {r["g"]: (r["n_chars"], r["sha256"]) for r in digest.joined_digest(rows, "g", ["i"], "t", F.lit("\né"), "öpen", slice_bytes).collect()}
    for g in ("a", "b", None):
        whole = "öpen" + "\né".join(t for x, _, t in TEXTS if x == g)
        assert got.pop(g) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    assert not got


def test_pieces_of_a_bundle_are_its_text(spark):
    rows = spark.createDataFrame([("en", "z", 1, "A", "u", "x"), ("en", "y", 2, "B", "", "y\n"), ("en", "z", 3, "C", None, "z"), ("en", "w", 0, "D", "", None), ("en", "w", 4, "E", "", "e")], "b string, t string, i int, title string, url string, body string")
    (whole,) = compiling.consolidated(rows, "b", "t", "title", "url", "body", "i").collect()
    assert whole["text"] == "### w\n\n#### E\n\ne\n\n### z\n\n#### A\n\n_Source: <u>_\n\nx\n\n#### C\n\nz\n\n### y\n\n#### B\n\ny\n\n"
    pieces = compiling.consolidated_pieces(rows, "b", "t", "title", "url", "body", "i")
    (hashed,) = digest.joined_digest(pieces, "b", ["first", "topic", "pos"], "piece", F.lit("\n"), slice_bytes=20).collect()
    assert (hashed["n_chars"], hashed["sha256"]) == (len(whole["text"]), hashlib.sha256(whole["text"].encode()).hexdigest())


@pytest.mark.parametrize("template", ["default", "minimal", "detailed", "api-reference"])
def test_pieces_of_a_template_are_its_page(spark, template):
    rows = spark.createDataFrame([("en", "B", "x\n", 1), ("en", "a", "y", 2), ("de", "c", "\nz", 3), ("en", "A", None, 4)], "b string, title string, body string, i int")
    pages = {r["b"]: r["page"] for r in sinks.templated(rows, "b", "title", "body", "i", template).collect()}
    assert pages["en"] == {
        "default": "## B\n\nx\n\n\n## a\n\ny", "minimal": "x\n\n\ny", "detailed": "# Contents\n\n- B\n- a\n- A\n\n## B\n\nx\n\n\n## a\n\ny", "api-reference": "## a\n\ny\n\n## B\n\nx\n",
    }[template]
    pieces = sinks.template_pieces(rows, "b", "title", "body", "i", template)
    got = digest.joined_digest(pieces, "b", ["section", "key", "pos"], "piece", F.col("separator"), sinks.template_opening(template), slice_bytes=10).collect()
    assert {r["b"]: r["sha256"] for r in got} == {b: hashlib.sha256(p.encode()).hexdigest() for b, p in pages.items()}


def test_context_keeps_digits_at_the_start_of_a_line(spark):
    rows = spark.createDataFrame([("# h\n_Source: x_\n20.1 kept 2",), ("0 kept 0",)], "t string")
    assert [r[0] for r in rows.select(readmodels.body_context(F.col("t"))).collect()] == ["20.1 kept 2", "0 kept 0"]


def test_a_name_asked_for_goes_before_versions_of_others(spark):
    entries = [(0, "hub", "brand#1~3", "Brand#1", "3", []), (1, "hub", "brand#13~2", "Brand#13", "2", []), (2, "web", "brand#14~5", "Brand#14", "5", []), (3, "hub", "brand#1~4", "Brand#1", "4", [])]
    terms = catalog.with_terms(spark.createDataFrame(entries, "pos int, source string, slug string, display_name string, version string, aliases array<string>"), ascii_only=True)
    wanted = spark.createDataFrame([("Brand#13",), ("Brand#14",), ("brand#2",)], "request string")
    got = {r["request"]: (r["source"], r["slug"], r["bucket"]) for r in catalog.resolve(terms, wanted, ascii_only=True, literal=True).collect()}
    assert got == {"Brand#13": ("hub", "brand#13~2", 2), "Brand#14": ("web", "brand#14~5", 2), "brand#2": (None, None, None)}
    assert {r["request"]: r["slug"] for r in catalog.resolve(terms, wanted, ascii_only=True).collect()}["Brand#13"] == "brand#1~3"  # as in versioned catalogs


def test_suggestions_work_a_name_out_once(spark):
    calls = text.normalise_language(F.col("x"), True)._jc.toString().count("regexp_extract")
    assert calls <= 2
    entries = [(i, "hub", f"x{i % 3}~{i}", f"X{i % 3}", str(i), ["yx1"]) for i in range(9)] + [(9, "web", "none", "None", "", [])]
    terms = catalog.with_terms(spark.createDataFrame(entries, "pos int, source string, slug string, display_name string, version string, aliases array<string>"), ascii_only=True)
    got = [tuple(r) for r in catalog.suggestions(terms, "x1", "x1").collect()]
    assert got == [("hub", "x1~1", "X1", 0), ("hub", "x0~0", "X0", 2), ("hub", "x2~2", "X2", 2)]


def test_slugs_of_a_hot_topic_are_numbered_in_linear_time(spark):
    n = 12_000
    rows = spark.range(n).select(F.lit("t").alias("topic"), F.when(F.col("id") == 5, "a-3").when(F.col("id") % 4 == 3, "b").otherwise("a").alias("slug"), F.col("id").alias("pos"))
    began = time.perf_counter()
    got = [(r["slug"], r["final_slug"]) for r in compiling.unique_slugs(rows, "topic", "slug", "pos").orderBy("pos").collect()]
    assert time.perf_counter() - began < 20  # the square of the rows took minutes
    names = [f for _, f in got]
    assert len(set(names)) == n and names[:8] == ["a", "a-2", "a-3", "b", "a-4", "a-3-2", "a-5", "b-2"]
    assert sum(f.startswith("b") for f in names) == n // 4 and f"b-{n // 4}" in names


def test_a_slug_is_worked_out_once(spark):
    rows = spark.createDataFrame([("--Été & Ñandú!",), ("CON",), ("***",), (None,), ("a" * 50 + "?",)], "t string")
    slug = text.slugify(F.col("t"))
    assert [r[0] for r in rows.select(slug).collect()] == ["ete-nandu", "con-item", "document", None, "a" * 50]
    assert str(slug._jc.toString()).count("regexp_replace") == 1


def test_the_index_is_written_without_a_shuffle(spark, capsys):
    texts = [(1, "b a\u212a b, Ünï_x B", "en"), (2, "", "de"), (3, "!?", "en"), (4, "a a z9 a", None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(1)
    rows = stored.postings(docs, keep=("lang",))
    got = [(r["term"], r["doc_id"], r["tf"], r["len"], list(r["positions"]), r["lang"]) for r in rows.collect()]
    assert got == [("a", 4, 3, 4, [0, 1, 3], None), ("ak", 1, 1, 6, [1], "en"), ("b", 1, 3, 6, [0, 2, 5], "en"), ("n", 1, 1, 6, [3], "en"), ("x", 1, 1, 6, [4], "en"), ("z9", 4, 1, 4, [2], None)]
    rows.explain()
    assert "Exchange" not in capsys.readouterr().out
    at = stored.write_index(docs, scratch(spark, "index"), parts=("identifiers",))
    assert exists(spark, f"{at.folder}/identifiers") and not exists(spark, f"{at.folder}/postings") and not stored.is_written(spark, at.folder, "postings")
    tasks = stored.write_index(docs.repartition(3), scratch(spark, "index")).of_terms(spark, ["a", "b"])
    assert sorted((r["term"], r["doc_id"]) for r in tasks.collect()) == [("a", 4), ("b", 1)]


def test_chunks_are_handed_over_a_few_texts_at_a_time(spark):
    rows = spark.createDataFrame([(i, f"k{i}", ("word " * 100 + "\n") * 700 if i % 3 else None) for i in range(9)], "i int, k string, t string")
    made = chunking.chunk_rows(rows, "t", ("k",), ("chunk_index", "char_end"), strategy="chars", max_chars=2000, overlap=200)
    got = {}
    for r in made.collect():
        got.setdefault(r["k"], []).append((r["chunk_index"], r["char_end"]))
    spans = chunking.char_chunks(("word " * 100 + "\n") * 700, 2000, 200)
    assert made.columns == ["k", "chunk_index", "char_end"] and set(got) == {f"k{i}" for i in range(9) if i % 3}
    assert all(v == [(n, b) for n, (_, b) in enumerate(spans)] for v in got.values())
    assert in_pieces((f"v{i}" for i in range(1000)), pa.string(), 7).to_pylist() == [f"v{i}" for i in range(1000)] and len(in_pieces(iter([]), pa.string())) == 0


def test_pages_of_an_archive_are_read_before_they_are_numbered(spark, capsys):
    members = spark.createDataFrame([(f"c/files/en-us/learn/p{i}/index.md", f"---\ntitle: T{i}\n---\nBody {i}") for i in range(5)], "member string, content string")
    made = adapters.archive_documents(members, "learn", ["guide"], "important", 1)
    assert [(r["order_hint"], r["title"], r["skip_reason"]) for r in made.orderBy("member").collect()] == [(i, f"T{i}", "checkpoint_resume_skip" if i <= 1 else "filtered_mode") for i in range(5)]
    made.explain()
    plan = capsys.readouterr().out
    assert plan.index("Window") < plan.index("EvalPython")  # plans are printed from their end
