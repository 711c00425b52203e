"""The language model against its definition in dictionaries."""

import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspan.llm import language_model as lm
from loomspan.llm import queries

TEXTS = [
    "the cat sat on the mat", "the cat sat on the hat", "The dog, the cat; the bird!", "a bird sat on a wire and a cat sat on the wire",
    "", None, "...", "on the mat the cat sat", "the the the the", "one two three four five six seven eight nine ten",
]


def brute(texts):
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    seqs = [["<s>", *w, "</s>"] if w else [] for w in words]
    c = Counter(b for s in seqs for b in zip(s, s[1:], strict=False))
    by = defaultdict(dict)
    for (v, w), n in c.items():
        by[v][w] = n
    a = Counter(w for _, w in c)

    def d(counts):
        n = Counter(counts)
        return lm.discounts(n[1], n[2], n[3], n[4])

    dh, dl = d(c.values()), d(a.values())
    total = sum(a.values())
    rest = sum(dl[min(x, 3)] for x in a.values()) / total

    def p1(w):
        return max(a[w] - dl[min(a[w], 3)], 0) / total + rest / (len(a) + 1)

    def p(v, w):
        if v not in by:
            return p1(w)
        t = sum(by[v].values())
        n = by[v].get(w, 0)
        return max(n - dh[min(n, 3)], 0) / t + sum(dh[min(x, 3)] for x in by[v].values()) / t * p1(w)

    return seqs, p, a


def test_scores_equal_the_definition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm.perplexity(docs).collect()}
    seqs, p, _ = brute(TEXTS * 3)
    assert len(got) == len(seqs)
    for i, s in enumerate(seqs):
        if not s:
            assert got[i]["n_tokens"] == 0 and got[i]["perplexity"] is None and got[i]["log_prob"] is None
            continue
        want = sum(math.log(p(v, w)) for v, w in zip(s, s[1:], strict=False))
        assert got[i]["n_tokens"] == len(s) - 1
        assert got[i]["log_prob"] == pytest.approx(want, rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(math.exp(-want / (len(s) - 1)), rel=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string")
    _, p, a = brute(TEXTS * 2)
    for v in ("<s>", "the", "cat", "never seen"):
        assert sum(p(v, w) for w in a) + p(v, "<unknown>") == pytest.approx(1.0)
    model = lm.train(docs)
    assert model.vocabulary == len(a) and model.continuations == sum(a.values())


def test_unseen_text_is_scored_and_worse(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    model = lm.train(docs)
    new = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "zyx wvu tsr qpo"), (None, "the dog")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["perplexity"] for r in lm.score(new, model).collect()}
    assert got[1] < got[2] and got[None] > 0


def test_counts_over_255_and_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "x y " * 400), (7, "x y " * 400), (8, "x z")], "doc_id bigint, text string")
    seqs, p, _ = brute(["x y " * 400, "x y " * 400, "x z"])
    got = sorted((r["doc_id"], r["log_prob"]) for r in lm.perplexity(docs).collect())
    want = sorted((d, sum(math.log(p(v, w)) for v, w in zip(s, s[1:], strict=False))) for d, s in zip((7, 7, 8), seqs, strict=True))
    assert [d for d, _ in got] == [7, 7, 8]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, slice string, piece string, perplexity string, n_tokens string"
    assert lm.perplexity(spark.createDataFrame([], schema)).collect() == []
    rows = lm.perplexity(spark.createDataFrame([(1, "a b", "s", "p", "x", "t")], schema)).collect()
    assert len(rows) == 1 and rows[0]["n_tokens"] == 3


def brute_of_order(texts, order):
    """(predictions of each text as tuples, p of a tuple) by the recursive definition."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    padded = [["<s>"] * (order - 1) + w + ["</s>"] if w else [] for w in words]
    grams = [[tuple(s[i : i + order]) for i in range(len(s) - order + 1)] for s in padded]
    counts = {order: Counter(g for s in grams for g in s)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds = {}
    for k, c in counts.items():
        n = Counter(c.values())
        ds[k] = lm.discounts(n[1], n[2], n[3], n[4])
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        ns = after[k].get(g[:-1])
        if ns is None:
            return p(g[1:])
        n, rest = counts[k][g], sum(ds[k][min(x, 3)] for x in ns) / sum(ns)
        return max(n - ds[k][min(n, 3)], 0) / sum(ns) + rest * (p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1))

    return grams, p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_every_order_equals_the_definition(spark, order):
    texts = [*TEXTS * 2, "x y " * 400, "x y " * 400, "sat the cat on the mat"]
    grams, p = brute_of_order(texts, order)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm.train(docs, order)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    for i, s in enumerate(grams):
        assert got[i]["n_tokens"] == len(s)
        if s:
            assert got[i]["log_prob"] == pytest.approx(sum(math.log(p(g)) for g in s), rel=1e-9)
    new = "on the wire sat zyx and the cat sat on"
    w = ["<s>"] * (order - 1) + new.split() + ["</s>"]
    (row,) = lm.score(spark.createDataFrame([(1, new)], "doc_id bigint, text string"), model).collect()
    assert row["log_prob"] == pytest.approx(sum(math.log(p(tuple(w[i : i + order]))) for i in range(len(w) - order + 1)), rel=1e-9)
    assert lm.perplexity(docs.limit(0), order).collect() == []


def test_the_query_looks_at_more_than_the_previous_word(spark, tmp_path):
    # The same bigrams in other order: only a model of order 3 or more tells them apart.
    texts = ["a b c b a b c"] * 9 + ["a b a b c b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_prob"] for r in queries.op5_lm_perplexity(spark, str(tmp_path)).collect()}
    assert got[9] < got[0] - 1


@pytest.mark.parametrize("width", range(1, 9))
def test_search_in_ranges_of_narrow_numbers(tmp_path, width):
    rng = np.random.default_rng(width)
    top = (1 << 8 * width) - 1
    ranges = [np.unique(rng.integers(0, top, n, np.uint64, endpoint=True)) for n in [0, 1, 2, 3, 0, 5, 8, 9, 100, 1000, 1, 0]]
    ranges[-2][:] = top
    lm._save(str(tmp_path), "part", lm._narrow("n", np.concatenate(ranges), width))
    part = lm._load(f"{tmp_path}/part")
    ends = np.cumsum([len(r) for r in ranges])
    asked = [(i, int(x)) for i, r in enumerate(ranges) for x in [0, top, *r, *rng.integers(0, top, 20, np.uint64, endpoint=True)]]
    rng.shuffle(asked)
    of = np.array([i for i, _ in asked], np.int64)
    at, known = lm._ragged(part, "n", ends[of] - [len(ranges[i]) for i in of], ends[of], np.array([x for _, x in asked], np.uint64))
    assert known.tolist() == [x in ranges[i] for i, x in asked]
    assert np.concatenate(ranges)[at[known]].tolist() == [x for (_, x), k in zip(asked, known, strict=True) if k]
    assert not lm._ragged(part, "n", ends[:0], ends[:0], np.zeros(0, np.uint64))[1].size


def test_a_search_takes_little_longer_than_in_plain_numbers():
    # Scoring is these searches for the most part: more than its budget went on putting each number together from its bytes.
    rng = np.random.default_rng(5)
    numbers = np.sort(rng.integers(0, 1 << 22, (200, 4096), np.uint64), axis=1).ravel()
    part = lm._narrow("n", numbers, 3)
    begin = rng.integers(0, 200, 300_000) * 4096
    wanted = numbers[begin + rng.integers(0, 4096, len(begin))]
    plain, sought = numbers.astype(np.uint32), wanted.astype(np.uint32)

    def plainly():
        a = begin.copy()
        for half in (1 << k for k in range(11, -1, -1)):
            a = np.where(plain[a + half] <= sought, a + half, a)
        return a

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert (numbers[plainly()] == wanted).all()
    assert lm._ragged(part, "n", begin, begin + 4096, wanted)[1].all()
    assert min(seconds(lambda: lm._ragged(part, "n", begin, begin + 4096, wanted)) for _ in range(5)) < 4.5 * min(seconds(plainly) for _ in range(5))
