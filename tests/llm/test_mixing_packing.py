"""Mixing and packing against row-by-row versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomspan.llm import mixing, packing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tag string, slice string, n_tokens string, last string, __ls_tag string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x", "y", "z", "l", "keep") for d, t, s in rows], SCHEMA)


def brute_mix(rows, weights, budget, seed=mixing.SEED, default=1.0):
    count = lambda t: len((t or "").split())
    key = lambda d: hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()
    by = defaultdict(list)
    for d, t, s in rows:
        if weights.get(s or "", default) > 0:
            by[s].append((key(d), -1 if d is None else d, count(t)))
    timed = []
    for s, members in by.items():
        for m in members:
            done = sum(x[2] for x in members if x <= m)
            timed.append((done / weights.get(s or "", default), "n" if s is None else "s" + s, *m))
    total = sum(x[4] for x in timed)
    return sorted(x[3] for x in timed if sum(y[4] for y in timed if y <= x) <= int(total * budget))


ROWS = [(i, "w " * (i % 13), f"s{i % 4}") for i in range(120)] + [(500, "a b c", "s0")] * 3 + [(None, "one two", "s1"), (501, None, "s2"), (502, "", "s3"), (503, "q r", None), (504, "w " * 5000, "s1")]


@pytest.mark.parametrize("budget", [0.0, 0.3, 0.8, 1.0])
def test_mix_equals_brute_force(spark, budget):
    weights = {"s0": 3.0, "s1": 0.5, "s3": 0.0}
    got = mixing.mix_sources(docs(spark, ROWS), weights, budget).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == brute_mix(ROWS, weights, budget)


def test_kept_rows_are_whole_and_those_of_the_mix(spark):
    table = docs(spark, ROWS)
    kept = mixing.keep_mixed(table, weights={"s0": 2.0}, budget_fraction=0.5)
    assert kept.columns == table.columns
    want = mixing.mix_sources(table, {"s0": 2.0}, 0.5)
    order = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    assert order(kept.collect()) == order(want.collect())


def test_ids_of_other_types(spark):
    table = docs(spark, ROWS).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    kept = mixing.keep_mixed(table, budget_fraction=0.5)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in mixing.mix_sources(table, budget_fraction=0.5).collect())
    with pytest.raises(TypeError, match="integral"):
        packing.pack_documents(table)


def test_blocks_lose_little_and_repeated_rows_spread(spark):
    r = np.random.default_rng(2)
    demand = np.stack([r.integers(20, 1500, 3000), r.integers(1, 12, 3000), r.integers(5, 900, 3000)], axis=1)
    whole = len(packing.pack_block(demand, (4096, 24, 3072)))
    rows = spark.createDataFrame([(i, *map(int, d)) for i, d in enumerate(demand)], "example_id bigint, n_tokens bigint, n_segments bigint, n_loss bigint")
    assert packing.pack(rows, (4096, 24, 3072), 500).count() <= 1.03 * whole
    equal = packing.pack(spark.range(1, 2).selectExpr("id as example_id", "explode(sequence(1, 4000)) as n").selectExpr("example_id", "1 n_tokens", "1 n_segments", "1 n_loss"), (4, 4, 4), 100).collect()
    assert sum(b["n_examples"] for b in equal) == 4000 and len({b["bin_id"].split("-")[0] for b in equal}) == 40 and len(equal) <= 1040


def test_prefixes_follow_the_weights(spark):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(2000)]
    got = mixing.mix_sources(docs(spark, rows), {"s0": 3.0, "s1": 1.0}, 0.3).collect()
    share = sum(r["n_tokens"] for r in got if r["source"] == "s0") / sum(r["n_tokens"] for r in got)
    assert share == pytest.approx(0.75, abs=0.01)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert mixing.keep_mixed(docs(spark, [])).collect() == []


def brute_pack(demand, limits):
    left_over, bins = [], []
    for i, d in enumerate(demand):
        (bins.append(([i], True)) if any(x > m for x, m in zip(d, limits, strict=True)) else left_over.append(i))
    while left_over:
        left, members = list(limits), []
        while True:
            fits = [i for i in left_over if all(x <= y for x, y in zip(demand[i], left, strict=True))]
            if not fits:
                break
            score = lambda i: float(np.array([x / m for x, m in zip(demand[i], limits, strict=True)]) @ np.array([y / m for y, m in zip(left, limits, strict=True)]))  # noqa: B023, E731
            best = max(fits, key=lambda i: (score(i), -i))
            members.append(best)
            left_over.remove(best)
            left = [y - x for x, y in zip(demand[best], left, strict=True)]
        bins.append((members, False))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4), st.integers(0, 12)), max_size=25))
def test_block_invariants(demand):
    exact = (8, 4, 16)  # shares are exact in binary, so that ties are ties in both
    assert packing.pack_block(np.array(demand, np.int64).reshape(-1, 3), exact) == brute_pack(demand, exact)
    bins = packing.pack_block(np.array(demand, np.int64).reshape(-1, 3), (10, 4, 8))
    assert sorted(i for m, _ in bins for i in m) == list(range(len(demand)))
    for members, over in bins:
        total = np.array([demand[i] for i in members]).sum(axis=0)
        assert over == bool((total > (10, 4, 8)).any())
    assert len(bins) == len(brute_pack(demand, (10, 4, 8)))


def test_pack_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "w " * (5 + c % 7)) for c in range(40) for t in range(1 + c % 5)]
    rows += [(None, 0, None, None), (99, 0, "assistant", "w " * 9000), (98, 0, "user", "")]
    got = packing.pack_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), (60, 8, 30), 16).collect()
    ids = [i for r in got for i in r["example_ids"]]
    assert len(ids) == len(set(ids)) == 43 and None in ids
    for r in got:
        assert r["oversize"] == (r["n_tokens"] > 60 or r["n_segments"] > 8 or r["n_loss"] > 30) and (not r["oversize"] or r["n_examples"] == 1)
    assert any(r["oversize"] and r["example_ids"] == [99] for r in got)


def test_pack_nothing_and_repeated_documents(spark):
    assert packing.pack_documents(docs(spark, [])).collect() == []
    got = packing.pack_documents(docs(spark, [(1, "a b", "s")] * 3 + [(None, None, None)])).collect()
    assert sum(r["n_examples"] for r in got) == 4
