"""The stored index, the match grammar, adapters, read models, converter and validator on small tables."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import html
from loomspan.operators import adapters, catalog, chunking, ingest, jobs, quality, readmodels, validation
from loomspan.operators import index as stored
from loomspan.operators import query as Q
from loomspan.operators import search
from loomspan.sources import external
from loomspan.storage import scratch

TEXTS = [
    (1, "alpha beta gamma", "en"), (2, "beta alpha. Alpha!", "en"), (3, "gamma delta get_value", "de"), (4, "alphabet soup", None), (5, "", "de"), (6, "beta x x x x x x x x x x x gamma", "en"),
]
QUERIES = ["alpha beta", "alpha OR delta", "beta NOT gamma", "(alpha OR delta) AND NOT_ OR gamma", '"beta alpha"', "alph*", "NEAR(beta gamma)", "NEAR(beta gamma, 20)", "(beta OR gamma) NOT (alpha OR delta)", "tongue:de gamma"]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string").withColumn("tongue", F.col("lang"))
    return docs, stored.write_index(docs, scratch(spark, "index"), attributes=("tongue",))


def test_index_and_scan_agree(spark, index):
    docs, at = index
    for text in QUERIES:
        if "NOT_" in text:
            continue
        got = sorted(r[0] for r in stored.match(spark, at, text).collect())
        assert got == sorted(r[0] for r in search.match(docs, text).select("doc_id").collect()), text
    want = [tuple(r) for r in search.bm25(docs, ["alpha", "beta"]).collect()]
    got = [tuple(r) for r in stored.bm25(spark, at, ["alpha", "beta"]).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert [tuple(r) for r in stored.xref_lookup(spark, at, "get_value").collect()] == [("de", 1, [3])]


def test_a_language_is_replaced_and_others_stay(spark, index):
    docs, at = index
    stored.write_index(spark.createDataFrame([(30, "delta only", "de", "de")], docs.schema), at.folder, attributes=("tongue",))
    assert sorted(r[0] for r in stored.match(spark, at, "delta OR alpha").collect()) == [1, 2, 30]
    assert stored.xref_lookup(spark, at, "get_value").collect() == []
    assert {r["language"] for r in at.documents(spark).select("language").distinct().collect()} == {"en", "de", None}


def test_grammar():
    assert Q.parse("  ") is None and isinstance(Q.parse("a"), Q.Leaf)
    assert Q.parse("a b OR c") == Q.Node("or", (Q.Node("and", (Q.Leaf("term", ("a",)), Q.Leaf("term", ("b",)))), Q.Leaf("term", ("c",))))
    assert Q.parse("(a OR b) AND c").kind == "and" and Q.parse("a NOT (b OR c)").kind == "not"
    for wrong in ("(a", "a)", "NOT a", "a OR", "a AND AND b", "^a"):
        with pytest.raises(ValueError):
            Q.parse(wrong)


def test_every_rule_of_a_bundle(spark):
    rich = (
        "## Documentation\n#### Early\n### T\n#### D\n#### D\n### T\n[r](x.md) ![i](y.png) [e]() [a](#none)\n<div>\n: def\n| a |\n| --- | --- |\n```\n"
    )
    rows = [("b1", rich, ["T"], 0, 1, 5, 0, 1), ("b2", None, [], 3, 3, 0, None, 0), ("b3", rich, [], 9, 9, 5, 1, 1), ("b4", "## Metadata ## Table of Contents ## Documentation " + "x" * 3000, ["T"], 1, 1, 1, 1, 0)]
    got = {}
    for r in validation.bundle_issues(spark.createDataFrame(rows, "bundle string, text string, topics array<string>, documents int, topic_documents int, discovered int, emitted int, skipped int")).collect():
        got.setdefault(r["bundle"], []).append(r["code"])
    assert got["b2"] == ["missing_output"] and "b4" not in got
    codes = {c for v in got.values() for c in v}
    assert codes == set(validation.RULES) and got["b1"].count("missing_section") == 2
    files = [("b", "t/_section.md", "[1](a.md) [2](a.md)"), ("b", "t/a.md", "# A b\n[x](#ab) [y](#gone) [z](b.md#q)"), ("b", "t/b.md", "# B\n[u](../t/a.md#ab) [v](../../out.md) [w](/abs.md)")]
    found = sorted((r["path"], r["code"]) for r in validation.document_issues(spark.createDataFrame(files, "bundle string, path string, text string")).collect())
    assert found == [("t/a.md", "broken_internal_link"), ("t/a.md", "broken_internal_link"), ("t/a.md", "duplicate_section_link"), ("t/a.md", "relative_link"), ("t/b.md", "broken_internal_link"), ("t/b.md", "broken_internal_link"), ("t/b.md", "relative_link")]


def test_deep_pages():
    for page in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<table><tr><td>" * 5_000 + "x", "<ul><li>" * 2_000 + "x"):
        began = time.process_time()
        markdown, _ = html.to_markdown(page)
        assert "x" in markdown and time.process_time() - began < 20


def test_breaker_on_timestamps_and_numbers(spark):
    events = spark.createDataFrame([("h", i, f"2024-01-01 00:00:{10 * i:02}", True) for i in range(4)] + [("h", 9, "2024-01-01 00:02:00", False)], "host string, n int, at string, failed boolean").withColumn("at", F.to_timestamp("at"))
    states = lambda e: [r["state"] for r in jobs.breaker_states(e, "host", "at", "n", "failed").orderBy("n").collect()]
    assert states(events) == states(events.withColumn("at", F.unix_micros("at"))) == ["closed", "closed", "closed", "open", "half_open"]


def test_progress_counts_the_kinds_asked_for(spark):
    log = spark.createDataFrame([("j", 1, "doc", "a"), ("j", 2, "bad", "b")], "job string, n int, kind string, message string")
    (r,) = jobs.progress(log, "job", "n", "kind", "message", "doc", "bad").collect()
    assert (r["documents"], r["failures"], r["last_message"], r["percent"]) == (1, 1, "b", 50.0)


def test_columns_of_callers_stay(spark):
    rows = spark.createDataFrame([(1, "k", "x", "en", 2.0, 7, 8, 9)], "pos int, key string, _n string, language string, score double, number int, place int, use int")
    for kept in (ingest.first_wins(rows, "key", "pos"), quality.last_n(rows, "language", "score", "pos", 1)):
        assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in rows.collect()]


def test_resolution_by_equality_equals_every_bucket(spark):
    entries = [(0, "hub", "node~18", "Node", "18.2", ["node.js"]), (1, "hub", "node~20", "Node", "20.1", []), (2, "web", "nodemon", "Nodemon", "", []), (3, "docset", "my-node-kit", "My Node Kit", "", [])]
    terms = catalog.with_terms(spark.createDataFrame(entries, "pos int, source string, slug string, display_name string, version string, aliases array<string>"))
    wanted = [("node",), ("node 20",), ("node 99",), ("nodem",), ("node kit",), ("",), ("none such",)]
    got = {r["request"]: (r["source"], r["slug"], r["bucket"]) for r in catalog.resolve(terms, spark.createDataFrame(wanted, "request string")).collect()}
    assert got["node"] == ("hub", "node~20", 2) and got["node 20"][:2] == ("hub", "node~20") and got["node 99"] == ("hub", "node~20", 3)
    assert got["nodem"] == ("web", "nodemon", 4) and got["node kit"] == ("docset", "my-node-kit", 5) and got["none such"] == got[""] == (None, None, None)


def test_crawl_rules(spark):
    page = '<a href="/docs/a">1</a><a href="b#x">2</a><a href="mailto:x@y">3</a><a href="/blog/c">4</a><a href="/docs/a">5</a><a href="https://h.org/docs/d">6</a>'
    got = adapters.crawl(spark.createDataFrame([(1, "https://h.org/docs/index.html", page)], "id int, url string, html string"), "id", "url", "html", most=4)
    assert [(r["target"], r["place"]) for r in got.orderBy("place").collect()] == [("https://h.org/docs/index.html", 1), ("https://h.org/docs/a", 2), ("https://h.org/docs/b#x", 3), ("https://h.org/docs/d", 4)]


def test_manifests_checkpoints_caches_and_settings(spark, tmp_path):
    entries = [{"slug": "a", "display_name": "A", "support_level": "supported"}, {"slug": "b", "support_level": "ignored"}, {"slug": "c"}]
    external.write_manifest(spark.createDataFrame([(e["slug"], e.get("display_name"), e.get("support_level")) for e in entries], "slug string, display_name string, support_level string"), str(tmp_path / "m"), "hub", "index page")
    assert sorted(r["slug"] for r in external.manifest(spark, str(tmp_path / "m")).collect()) == ["a", "c"]
    (tmp_path / "cp").mkdir()
    for name, body in (("x", {"schema_version": 1, "slug": "x", "phase": "fetching"}), ("y", {"schema_version": 2, "slug": "y"})):
        (tmp_path / "cp" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "cp" / "z.json").write_text("{broken")
    assert [r["slug"] for r in external.checkpoints(spark, str(tmp_path / "cp")).collect()] == ["x"]
    (tmp_path / "cache" / "hub").mkdir(parents=True)
    (tmp_path / "cache" / "hub" / "a.meta.json").write_text(json.dumps({"source": "hub", "cache_key": "a/b", "byte_count": 3}))
    (tmp_path / "cache" / "hub" / "b.meta.json").write_text("nope")
    got = {r["path"].rsplit("/", 1)[1]: (r["cache_key"], r["raw"]) for r in external.cache_metadata(spark, str(tmp_path / "cache")).collect()}
    assert got == {"a.meta.json": ("a/b", None), "b.meta.json": (None, "nope")}
    (tmp_path / "s.json").write_text(json.dumps({"b": 5, "c": "x"}))
    assert external.settings(spark, {"a": "1", "b": "2"}, str(tmp_path / "s.json")) == {"a": "1", "b": "5", "c": "x"} and external.settings(spark, {"a": "1"}, str(tmp_path / "none.json")) == {"a": "1"}
    (tmp_path / "corpus.json").write_text(json.dumps({"languages": ["Python", {"name": "Go"}]}))
    (tmp_path / "list.json").write_text(json.dumps(["Rust"]))
    assert external.corpus_names(spark, str(tmp_path / "corpus.json")) == ["Python", "Go"] and external.corpus_names(spark, str(tmp_path / "list.json")) == ["Rust"]


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_token_chunks_of_a_vocabulary(spark):
    text = "Größe, naïve 😀 text of some words. " * 40
    tokenizer = chunking.BpeSpans(VOCABULARY)
    spans = tokenizer(text)
    pieces = tokenizer.encoding.encode_ordinary(text)
    assert len(spans) == len(pieces) and spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b and c >= a for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), strategy="tokens", max_tokens=50, overlap_tokens=10, tokenizer=chunking.BpeSpans(VOCABULARY)).orderBy("chunk_index").collect()
    assert [(r["token_start"], r["token_end"]) for r in rows] == chunking.token_chunks(spans, 50, 10) and all(text[r["char_start"] : r["char_end"]] == r["text"] for r in rows)


def test_presets_are_whole(spark):
    rows = readmodels.presets(spark)
    assert rows.select("preset").distinct().count() == 8 and rows.where("preset = 'webapp'").count() == 17
    langs = spark.createDataFrame([("python",), ("Cobol",)], "language string")
    assert [tuple(r) for r in readmodels.categories(langs, rows).collect()] == [("python", ["backend", "data", "python-stack"])]
