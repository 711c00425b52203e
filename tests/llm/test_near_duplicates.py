"""The n-gram join and the embedding join against all pairs."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import near_duplicates as nd
from loomspan.llm import vectors
from loomspan.llm.components import components


def sets_of(text, n):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(rows, n, t):
    by = {}
    for d, text in rows:
        if d is not None and sets_of(text, n):
            by.setdefault(d, []).append(sets_of(text, n))
    ids = sorted(by)
    root = {d: d for d in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(len(x & y) >= t * len(x | y) for x in by[a] for y in by[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    groups = {}
    for d in ids:
        groups.setdefault(find(d), []).append(d)
    return {(d, min(g), len(g)) for g in groups.values() if len(g) > 1 for d in g}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(words, k=40))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.45:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, max(1, len(w) // 6))):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind < 0.65:
            text = passage + " " + " ".join(r.choices(words, k=r.randint(0, 60)))
        else:
            text = " ".join(r.choices(words, k=r.choice([1, 2, 3, 5, 8, 20, 60, 150])))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize(("seed", "n", "t", "frequent"), [(1, 3, 0.5, (128, 100_000)), (2, 2, 0.5, (2, 6)), (3, 3, 0.7, (3, 8)), (4, 1, 0.8, (2, 4))])
def test_groups_equal_all_pairs(seed, n, t, frequent):
    rows = corpus(seed, 160) + [(900, None), (901, ""), (902, "!!"), (None, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4 w5"), (903, "Long " * 3000)]
    got = _groups_local(rows, n, t, frequent)
    assert got == brute_groups(rows, n, t)


def _groups_local(rows, n, t, frequent):
    """Candidates by shared signatures, every one verified: what the join must find, without Spark."""
    usable = [(d, x) for d, x in rows if d is not None and x]
    tokens, counts = nd.token_sets([x for _, x in usable], n)
    owner = np.repeat(np.arange(len(counts)), counts)
    each, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
    frequency = df[inverse]
    shared = frequency > 1
    own = counts - np.bincount(owner[shared], minlength=len(counts))
    hopeful = (counts > 0) & (own <= np.array([nd.tolerated(int(c), t) for c in counts]))
    compact = np.cumsum(hopeful) - 1
    keep = shared & hopeful[owner]
    by, found = nd.signatures(compact[owner[keep]], tokens[keep], frequency[keep], counts[hopeful], t, frequent)
    ids = [d for (d, _), h in zip(usable, hopeful, strict=True) if h]
    texts = [sets_of(x, n) for (_, x), h in zip(usable, hopeful, strict=True) if h]
    lists = {}
    for o, s in zip(by.tolist(), found.tolist(), strict=True):
        lists.setdefault(s, set()).add(o)
    root = {d: d for d in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in {(a, b) for m in lists.values() for a in m for b in m if a < b}:
        if ids[a] != ids[b] and len(texts[a] & texts[b]) >= t * len(texts[a] | texts[b]):
            lo, hi = sorted((find(ids[a]), find(ids[b])))
            root[hi] = lo
    groups = {}
    for d in set(ids):
        groups.setdefault(find(d), []).append(d)
    return {(d, min(g), len(g)) for g in groups.values() if len(g) > 1 for d in g}


def brute_links(rows, n, t):
    """Linked (id, text) entries of other rows, equal rows once, summed by id."""
    entries = list({(d, frozenset(sets_of(x, n))) for d, x in rows if d is not None and sets_of(x, n)})
    found = {}
    for i, (d, a) in enumerate(entries):
        found[d] = found.get(d, 0) + sum(len(a & b) >= t * len(a | b) for k, (_, b) in enumerate(entries) if k != i)
    return found


@pytest.mark.parametrize("cell", [3, 2048])
def test_join_in_spark_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(nd, "CELL", cell)
    monkeypatch.setattr(nd, "COMMON", 4 if cell == 3 else 24)
    rows = corpus(7, 150) + [(900, None), (901, ""), (None, "w1 w2 w3 w4"), (902, "w1 w2"), (903, "w1 w2"), (5, "w1 w2 w3 w4 w5"), (904, "Long " * 3000)] + corpus(7, 3)
    docs = spark.createDataFrame([(d, x, "a", "b", 1, 2) for d, x in rows], "doc_id bigint, text string, tokens string, block string, other int, count int")
    got = nd.near_duplicate_groups(docs).collect()
    want = brute_groups(rows, 3, 0.5)
    assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
    links = brute_links(rows, 3, 0.5)
    assert {r["doc_id"]: r["n_links"] for r in got} == {d: links[d] for d, _, _ in want}
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    drop = {d for d, g, _ in want if d != g}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in {(d, x) for d, x in rows} if d not in drop)


def test_tiny_documents_that_share_one_frequent_phrase(spark):
    """Documents of one and two n-grams; the shared one is frequent, and only those with the document of one n-gram join."""
    rows = [(i, f"a b c x{i}") for i in range(300)] + [(1000, "a b c"), (1001, "d e f"), (1002, "d e f g")] + [(2000 + i, f"p q r y{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["n_links"] for r in nd.near_duplicate_groups(docs).collect()}
    assert got == {**dict.fromkeys(range(300), 1), 1000: 300, 1001: 1, 1002: 1}


def test_shuffled_tokens_go_when_they_are_written(spark, monkeypatch):
    """The shuffles that hold the tokens leave no file behind, without a garbage collection in the driver."""
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left, write = {}, nd.materialise

    class Enough(Exception):
        pass

    def files():
        return {f for folder in folders for f in folder.rglob("shuffle_*")}

    def materialise(df, label, **options):
        before, written, end = files(), write(df, label, **options), time.monotonic() + 10
        while label in ("signed", "sets") and files() - before and time.monotonic() < end:
            time.sleep(0.1)
        left[label] = files() - before
        if label == "sets":
            raise Enough
        return written

    monkeypatch.setattr(nd, "materialise", materialise)
    docs = spark.createDataFrame(corpus(3, 60), "doc_id int, text string")
    with pytest.raises(Enough):
        nd.near_duplicate_groups(docs)
    assert left["signed"] == left["sets"] == set()


def test_workers_give_back_what_earlier_stages_left(spark):
    """An earlier stage leaves freed memory in every Python worker; after the index most of it is gone."""
    psutil = pytest.importorskip("psutil")

    def leave(batches):
        import sys

        for _ in batches:
            blocks = [(np.ones(100_000, np.uint8), np.ones(20_000, np.uint8)) for _ in range(1500)]
            sys.pinned = [small for _, small in blocks]  # between the large ones, so that freeing those alone returns nothing
            del blocks
            time.sleep(1)  # the tasks run side by side, each in its worker
            yield pa.record_batch([[1]], ["n"])

    def held():
        workers = [p.pid for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
        return sum(int(mb) for pid in workers for mb in re.findall(r"\nPrivate_Dirty:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())) / 1024

    spark.range(0, 4, 1, 4).mapInArrow(leave, "n bigint").collect()
    before = held()
    docs = spark.createDataFrame(corpus(3, 60), "doc_id int, text string").repartition(12)
    nd.materialise(nd.indexed(docs, 3, 0.5), "signed")
    assert before > 600 and before - (after := held()) > 200, (before, after)


def test_rows_are_sent_few_at_once(spark, monkeypatch):
    """Texts and pairs of sets reach a worker at most BATCH_ROWS at once; the session's setting is as it was."""
    setting, asked, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, nd.materialise

    def materialise(df, label, **options):
        asked.setdefault(label, options.get("batch"))
        return write(df, label, **options)

    monkeypatch.setattr(nd, "materialise", materialise)
    nd.near_duplicate_groups(spark.createDataFrame(corpus(3, 60), "doc_id int, text string"), links=False)
    assert asked["signed"] == asked["joined"] == nd.BATCH_ROWS
    before = spark.conf.get(setting)
    sizes = write(spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (pa.record_batch([[b.num_rows]], ["n"]) for b in batches), "n bigint"), "sizes", batch=8)
    assert max(r["n"] for r in sizes.collect()) == 8 and spark.conf.get(setting) == before


def test_ids_are_integral(spark):
    docs = spark.createDataFrame([("1", "a b c d")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integral"):
        nd.near_duplicate_groups(docs)


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert nd.near_duplicate_groups(docs).collect() == [] and nd.keep_one_of_each(docs).collect() == []
    alone = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id bigint, text string")
    assert nd.near_duplicate_groups(alone).collect() == [] and nd.keep_one_of_each(alone).count() == 2


def test_components_equal_a_walk(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {tuple(x) for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for x in list(parent)}


def cosines(v):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("cell", [8, 4096])
def test_embedding_classes_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 16))
    near = base[:80] + 0.02 * r.standard_normal((80, 16))
    many = base[80] + 0.02 * r.standard_normal((60, 16))
    v = np.concatenate((base, near, many, base[:5], base[:3] * 7.0)).astype(np.float32)
    odd = [(1400, None), (1401, []), (1402, [0.0] * 16), (1403, [float("nan")] * 16), (None, [1.0] * 16), (1404, [1.0, None] * 8), (1405, [1.0] * 8), (0, [float(x) for x in v[0]])]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + odd
    table = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id bigint, embedding array<float>, rep int, key int, h int")
    got = {x["vec_id"]: (x["class_id"], x["n_links"]) for x in vectors.near_classes(table).collect()}
    near = cosines(v) >= vectors.THRESHOLD
    links = near.sum(axis=1) - 1
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.array([root[row].min() for row in near])
    assert got == {i: (int(root[i]), int(links[i])) for i in range(len(v)) if links[i]}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_classes(empty).collect() == []


def test_no_embedding_link_is_left_out(spark):
    """1,500 pairs just above the threshold, and as many just below it."""
    r = np.random.default_rng(9)
    a, b = r.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = np.where(np.arange(3000) < 1500, 1e-6, -1e-6)[:, None] + vectors.THRESHOLD
    v = np.concatenate((a, c * a + np.sqrt(1 - c**2) * b))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(x) for x in vectors.near_classes(table).collect())
    assert got == [(i, i % 3000, 1) for i in range(6000) if i % 3000 < 1500]


@pytest.mark.parametrize("recall", [1.0, 0.9999999])
def test_chains_of_embeddings_are_one_class(spark, recall):
    """Four vectors 15 degrees apart in a plane of their own: only neighbours are linked, and all are of one class."""
    r, rows = np.random.default_rng(2), []
    ids = r.permutation(160).tolist()
    for chain in range(40):
        for step in range(4):
            v = [0.0] * 80
            v[2 * chain], v[2 * chain + 1] = np.cos(np.pi / 12 * step).item(), np.sin(np.pi / 12 * step).item()
            rows.append((ids[4 * chain + step], v))
    got = {tuple(x) for x in vectors.near_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=recall).collect()}
    assert got == {(ids[4 * c + s], min(ids[4 * c : 4 * c + 4]), 1 if s in (0, 3) else 2) for c in range(40) for s in range(4)}


def test_several_vectors_of_an_id_and_ties(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [2.0, 0.0]), ("d", [-1.0, 0.0])]
    got = vectors.near_classes(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), threshold=0.8, recall=0.999999).collect()
    assert sorted(map(tuple, got)) == [("a", "a", 1), ("a", "a", 1), ("b", "a", 1), ("c", "a", 1)]  # 0.8 is reached exactly


def test_promised_recall_at_the_threshold():
    """Pairs exactly at the threshold meet in a table, and pass the sketches, as often as promised."""
    r = np.random.default_rng(1)
    a, b = r.standard_normal((2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = vectors.THRESHOLD * a + np.sqrt(1 - vectors.THRESHOLD**2) * b
    k, l = vectors.tables_for(10_000, vectors.THRESHOLD)
    meet = (vectors.bucket_keys(a, k, l) == vectors.bucket_keys(near, k, l)).any(axis=1)
    assert meet.mean() >= vectors.RECALL - 0.02
    differ = np.bitwise_count(vectors.sketches(a) ^ vectors.sketches(near)).sum(axis=1)
    assert differ.max() <= vectors.most_differing(vectors.THRESHOLD)


def test_tables_follow_the_rows():
    small, large = vectors.tables_for(100, 0.95), vectors.tables_for(10**9, 0.95)
    assert small[0] < large[0] and small[1] < large[1]
    assert vectors.collision(0.3) > vectors.collision(1.0)
