"""Media round trips and the pipeline against brute force."""

import hashlib
import random
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import media, mixing, near_duplicates, packing, pii, toxicity
from loomspan.llm.store import local_path

from .test_near_duplicates import brute_groups
from .test_text_operators import labelled

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + b"\0" * 4
GIF = b"GIF89a" + struct.pack("<HH", 12, 34) + b"\0" * 20
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 111, 222, 3) + b"\0" * 30
WAV = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 64000) + b"\1\2" * 32000
HTML = b"<!DOCTYPE html><html lang='de'><head><meta charset=\"UTF-8\"></head>" + b"<p>text</p>" * 3000
PAYLOADS = [(1, PNG), (2, GIF), (3, JPEG), (4, WAV), (5, HTML), (6, b""), (7, None), (8, PNG), (8, PNG), (None, GIF), (9, b"\0\xff\xfe" * 50), (10, "plain text ü".encode()), (11, b"\x89PNG\r\n\x1a\n")]


def test_round_trip(spark):
    rows = spark.createDataFrame([(i, p, "d", "s") for i, p in PAYLOADS], "id bigint, body binary, digest string, shard string").repartition(3)
    digests, index, folder = media.store_media(rows, "id", "body", shard_bytes=20_000)
    places = {r["digest"]: r for r in index.collect()}
    assert digests.count() == len(PAYLOADS) and len(places) == len({p for _, p in PAYLOADS if p is not None})
    for _, body in PAYLOADS:
        if body is not None:
            r = places[hashlib.sha256(body).hexdigest()]
            assert media.read_payload(folder, r["shard"], r["shard_offset"], r["stored_length"], r["encoding"]) == body and r["size"] == len(body)
            head = media.read_payload(folder, r["shard"], r["shard_offset"], r["stored_length"], r["encoding"], 64)
            assert body.startswith(head[:64])
    for r in places.values():
        with tarfile.open(f"{local_path(folder)}/{r['shard']}") as tar:
            assert any(m.name.split(".")[0] == r["digest"] and m.offset_data == r["shard_offset"] and m.size == r["stored_length"] for m in tar)
    assert places[hashlib.sha256(HTML).hexdigest()]["encoding"] == "zstd"


def test_header_columns(spark):
    rows = spark.createDataFrame(PAYLOADS, "id bigint, body binary")
    got = {r["id"]: r for r in media.media_columns(rows, "id", "body").collect()}
    assert (got[1]["media_type"], got[1]["width"], got[1]["height"], got[1]["channels"]) == ("image/png", 640, 480, 3)
    assert (got[2]["width"], got[2]["height"]) == (12, 34) and (got[3]["width"], got[3]["height"]) == (222, 111)
    assert (got[4]["sample_rate"], got[4]["channels"], got[4]["duration_ms"]) == (8000, 2, 2000)
    assert (got[5]["media_type"], got[5]["charset"], got[5]["language"]) == ("text/html", "utf-8", "de")
    assert got[6]["media_type"] == "empty" and got[7]["digest"] is None and got[9]["media_type"] == got[11]["media_type"] == "application/octet-stream" and got[10]["media_type"] == "text/plain"
    assert media.media_columns(rows.limit(0), "id", "body").collect() == []
    assert zlib.crc32(PNG) and len(media.media_columns(rows, "id", "body").collect()) == len(PAYLOADS)


def test_headers_behind_long_notes(spark):
    note = b"\xff\xe1" + struct.pack(">H", 60_000) + b"e" * 59_998
    picture = JPEG[:20] + note * 3 + JPEG[20:]
    sound = WAV[:36] + b"LIST" + struct.pack("<I", 9_001) + b"n" * 9_002 + WAV[36:]
    for header_bytes in (media.HEADER_BYTES, 64):
        got = {r["id"]: r for r in media.media_columns(spark.createDataFrame([(1, picture), (2, sound)], "id bigint, body binary"), "id", "body", header_bytes=header_bytes).collect()}
        assert (got[1]["media_type"], got[1]["width"], got[1]["height"]) == ("image/jpeg", 222, 111)
        assert (got[2]["media_type"], got[2]["sample_rate"], got[2]["duration_ms"]) == ("audio/wav", 8000, 2000)


def test_headers_of_pages_that_hardly_compress(spark):
    r = random.Random(5)
    page = lambda n: b"<!doctype html><html lang='fr'><head><meta charset='utf-8'></head><p>" + r.randbytes(n).hex().encode()
    pages = [(i, page(n)) for i, n in enumerate((2_000, 5_000, 10_000, 200_000))]
    for header_bytes in (media.HEADER_BYTES, 500):
        got = media.media_columns(spark.createDataFrame(pages, "id bigint, body binary"), "id", "body", header_bytes=header_bytes).collect()
        assert {(x["encoding"], x["media_type"], x["charset"], x["language"]) for x in got} == {("zstd", "text/html", "utf-8", "fr")} and len(got) == len(pages)
    _, index, folder = media.store_media(spark.createDataFrame(pages, "id bigint, body binary"), "id", "body")
    bodies = {hashlib.sha256(b).hexdigest(): b for _, b in pages}
    for x in index.collect():
        place, body = (folder, x["shard"], x["shard_offset"], x["stored_length"], x["encoding"]), bodies[x["digest"]]
        assert media.read_payload(*place) == body
        assert all(media.read_payload(*place, n) == body[:n] for n in (1, 4096, 5000, 150_000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = labelled(150)
    docs = [(d, t, "en", f"src{d % 4}", len(t)) for d, t, _ in rows]
    docs += [(200 + i, rows[i][1] + " end", "en", "src1", len(rows[i][1]) + 4) for i in (1, 2, 4)]
    docs += [(300, "mail a.b1@mail.example.com here", "en", "src0", 31), (301, None, None, None, None), (302, "", "en", "src2", 0), (303, rows[1][1], "en", "src3", 1), (303, rows[1][1], "en", "src3", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = docs.columns
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    model = toxicity.train_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = stage(spark, docs, folder)
        assert after.columns == plain
        got = after.collect()
        if name == "toxicity":
            want = [tuple(r) for r in before if model.score(r["text"]) < toxicity.THRESHOLD]
        elif name == "near_duplicates":
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before], near_duplicates.NGRAM, near_duplicates.THRESHOLD)
            drop = {d for d, g, _ in groups if d != g}
            assert drop
            want = list({tuple(r) for r in before if r["doc_id"] not in drop})
        elif name == "pii":
            want = [(r[0], t := pii.redact_text(r[1]), r[2], r[3], None if t is None else len(t) if r[4] is not None else None) for r in before]
        else:
            ids = {r["doc_id"] for r in mixing.mix_sources(docs).collect()}
            want = [tuple(r) for r in before if r["doc_id"] in ids]
        assert order(got) == order(want), name
        docs = spark.createDataFrame(got, docs.schema)
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(str(i) for b in bins for i in b["example_ids"]) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(b["oversize"] or b["n_tokens"] <= packing.DOCUMENT_LIMITS[0] for b in bins)


def test_stages_keep_clashing_columns_and_take_nothing(spark, folder):
    names = ["other", "tag", "last", "number", "root", "node", "score", "place", "set_id", "tokens", "block", "finish_time"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, folder)
        rows = wide.collect()
        assert wide.columns == [*docs.columns, *names] and rows and all(r[n] == n for r in rows for n in names)
        wide = spark.createDataFrame(rows, wide.schema)
    assert sum(b["n_examples"] for b in corpus_pipeline.STAGES[-1][1](spark, wide, folder).collect()) == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[0] == "bin_id" and got.count() >= 1
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
