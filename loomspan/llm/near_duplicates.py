"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word n-grams (see ``words``), its tokens here.  Two documents join where the
Jaccard similarity of their sets reaches the threshold t.  The join is exact:

* A token of one document only can never be shared.  A document with n tokens tolerates
  e = n - ceil(t n) tokens that its partner lacks, so one with more than e tokens of its own has no
  partner and leaves before anything of it is indexed.
* The rest order their tokens from rare to frequent.  Tokens fall into classes by document frequency:
  rare ones are signatures by themselves, those of the frequent classes only in combinations of k = 2
  or 3.  A prefix is extended until losing e tokens cannot lose all its signatures: a group of
  m tokens that makes combinations of k survives m - k losses, so the prefix needs a sum of
  (m - k + 1) over its groups of at least e + 1.  Then any two joined documents share a signature.
* Frequent tokens are split into groups by hash so that combinations stay in proportion to the
  prefix.  The number of groups depends on the size band of the smaller document of a pair, so
  each document signs for its own band and the one below (a partner has at most 1/t <= 2 times the tokens).
  There are never more groups than leave a document of the band its e + 1 (see ``_combinations``).
* A document of one token can only meet one of two that holds it; both sign the token in a list of its own kind, in
  which only these pairs are candidates.
* Documents that share a signature are candidates; each is verified on its whole set.

Which documents belong together is settled first, in rounds: each list of sharers is represented by one member, and each
component is tried with the representatives it shares most signatures with; when a round joins little more, every
candidate pair whose sides are still apart is verified.  Then the links are counted: the sets of a
component are compared with each other in full, in cells of at most CELL sets of a component by CELL, each of which is a task's work.
No list of sharers and no component is gathered in one row, and no pair inside a component is written out.

Tokens are 64-bit hashes of n-grams.  Two of different n-grams agree with a chance of 5e-20, so that a similarity is
wrong by one token in one of some 10^14 pairs of texts of 500 tokens.

Defined cases
* null or empty text, or one without words: joined with nothing
* fewer than n words: one token of all the words
* equal texts, and texts of equal token sets: joined
* repeated rows of one doc_id: one document each; a doc_id with itself is no pair, so it is listed only
  if another doc_id is near; of repeated rows, the filter keeps one
* an id with several texts: one row, with the links of all its texts
* null doc_id: takes part in nothing and is kept by the filter; doc_id is of an integral type, any other raises TypeError
* ties: the lowest doc_id of a group represents it
* very long texts: whole; empty table: no rows; extra columns, whatever their names, pass through the filter untouched
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, runs
from .components import components
from .store import fresh, integral, lean_group, lean_stream, materialise, slices_for
from .words import chunks, gram_hashes, mix, word_hashes

NGRAM, THRESHOLD = 3, 0.5
BLOCK_TOKENS = 600_000
#: Rows, each with a text or two sets, that a worker is sent at once.
BATCH_ROWS = 1000
#: Document frequencies above which tokens sign in combinations of 2, and of 3.
FREQUENT = (128, 100_000)
#: Sets of a component that a task compares with as many others.
CELL = 2048
#: Tokens that more sets of a cell hold than this are counted as a product of matrices, others pair by pair.
COMMON = 24
#: Rounds go on while at least this share of the candidates they try joins.
YIELD = 0.25
#: Tables of two or three numbers a row are known to every task up to this many rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def token_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each text, sorted within the text; how many each has)."""
    grams, counts = gram_hashes(*word_hashes(texts), n)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(counts))


def tolerated(n: int, t: float) -> int:
    """Tokens of n that a partner may lack."""
    return n - math.ceil(t * n - 1e-9)


def _chain(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[-1]), 0x51ED270B, np.uint64)
    for c in columns:
        h = mix((h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def _combinations(band: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens a combination, groups) of frequent tokens in a size band (2^(b-1) to 2^b - 1 tokens) by class.

    A group costs k - 1 tokens of capacity, and a document of n >= 2^(b-1) tokens has to keep n // 2 + 1 of n,
    so the groups of a band may cost 2^(b-2) - 1 in all.
    """
    size = np.int64(1) << np.maximum(band, 0)
    pairs = np.where(band >= 5, size >> 3, 1)
    triples = np.maximum(1, (size >> 4) - 1)
    k = np.where(band >= 4, k, np.minimum(k, 2))
    return np.where(band == 1, 1, k), np.where(k == 2, pairs, triples)


def signatures(
    owner: np.ndarray, tokens: np.ndarray, frequency: np.ndarray, size: np.ndarray, t: float, frequent: tuple[int, int] = FREQUENT
) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of documents 0 to len(size) - 1 with size[i] tokens each, of which those given are shared with others.

    The lowest bit of a signature is set in the lists of documents of one token.
    """
    order = np.lexsort((tokens, frequency, owner))
    owner, tokens, frequency = owner[order], tokens[order], frequency[order]
    begin = np.searchsorted(owner, np.arange(len(size) + 1))
    shared = np.diff(begin)
    need = np.array([tolerated(int(n), t) for n in size], np.int64) - (size - shared) + 1
    rank = np.arange(len(owner)) - begin[owner]
    kind = np.searchsorted(np.asarray(frequent), frequency, "left") + 1
    rare, band = kind == 1, np.frexp(size.astype(np.float64))[1].astype(np.int64)
    single, star = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    out = []
    for b_of in (band, band - 1):
        b = b_of[owner]
        k, groups = _combinations(b, kind)
        some = np.flatnonzero(~rare & (b >= 2))
        group = mix(tokens[some] + b[some].astype(np.uint64)) % groups[some].astype(np.uint64)
        by = np.lexsort((rank[some], group, k[some], owner[some]))
        some, group = some[by], group[by]
        new = np.ones(len(some), bool)
        new[1:] = (owner[some][1:] != owner[some][:-1]) | (k[some][1:] != k[some][:-1]) | (group[1:] != group[:-1])
        run = np.cumsum(new) - 1
        nth = np.arange(len(some)) - np.flatnonzero(new)[run] if len(some) else np.zeros(0, np.int64)
        gain = np.ones(len(owner), np.int64)
        gain[some] = nth >= k[some] - 1
        before = np.cumsum(gain) - gain
        before -= before[begin[owner]] if len(owner) else 0
        prefix = (before < need[owner]) & (b >= 1)
        single |= prefix & rare
        star |= prefix & ~rare & (b == 1)
        inside = prefix[some]
        some, run = some[inside], run[inside]
        longest = int(np.bincount(run).max()) if len(run) else 0
        for i in range(1, longest):
            pair = np.flatnonzero(run[i:] == run[:-i])
            if not len(pair):
                break
            two = pair[k[some[pair]] == 2]
            x, y = some[two], some[two + i]
            out.append((owner[x], _chain(b[x], tokens[x], tokens[y])))
            three = pair[k[some[pair]] == 3]
            for j in range(i + 1, longest if len(three) else 0):
                fits = three[three + j < len(run)]
                fits = fits[run[fits] == run[fits + j]]
                x, y, z = some[fits], some[fits + i], some[fits + j]
                out.append((owner[x], _chain(b[x], tokens[x], tokens[y], tokens[z])))
    out.append((owner[single], _chain(tokens[single])))
    owners, hashes = np.concatenate([o for o, _ in out]), np.concatenate([h for _, h in out]) << np.uint64(1)
    return np.concatenate((owners, owner[star])), np.concatenate((hashes, _chain(tokens[star]) << np.uint64(1) | np.uint64(1)))


def indexed(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, size, own, tokens, signatures) of the documents that may have a partner.

    tokens is a blob of those that other documents share, own the number of the others.
    """
    rows = docs.select(integral(docs, "doc_id").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    n_slices = slices_for(rows, "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block
            ids = np.concatenate([h[0] for h in held])
            tokens, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            bounds = blobs.slices(tokens, 64, n_slices)
            out = [(-1, block, blobs.encode([ids.view(np.uint64), counts]))]
            out += [(s, block, blobs.encode([tokens[a:b], owner[a:b]], (0,))) for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
            block += 1
            return pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["slice", "block", "piece"])

        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for start, texts in chunks(x.as_py() for x in batch.column(1)):
                tokens, counts = token_sets(texts, n)
                held.append((ids[start : start + len(texts)], tokens, counts))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def find_shared(group: pa.Table) -> pa.Table:
        if group.column("slice")[0].as_py() < 0:  # the documents of a block: nothing to count
            return group.select(["block", "slice", "piece"])
        # Arrays of a whole slice are narrow, and go as soon as they are used.
        blocks = group.column("block").to_pylist()
        pieces = [(tokens, owner.astype(np.uint32)) for tokens, owner in (blobs.decode(x.as_py()) for x in group.column("piece"))]
        sizes = [len(p[0]) for p in pieces]
        owner = np.concatenate([p[1] for p in pieces])
        tokens = np.concatenate([p[0] for p in pieces])
        del pieces
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        new = np.ones(len(ordered) + 1, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
        del ordered
        df = np.diff(np.flatnonzero(new)).astype(np.uint32)
        frequency = np.empty(len(tokens), np.uint32)
        frequency[order] = np.repeat(df, df)
        del order, new, df
        out, at = [], 0
        for block, size in zip(blocks, sizes, strict=True):
            shared = np.flatnonzero(frequency[at : at + size] > 1) + at
            out.append((block, 0, blobs.encode([tokens[shared], owner[shared], frequency[shared]], (0,))))
            at += size
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "slice", "piece"])

    def sign(group: pa.Table) -> pa.Table:
        pieces = [(s.as_py(), blobs.decode(x.as_py())) for s, x in zip(group.column("slice"), group.column("piece"), strict=True)]
        ids, counts = next(p for s, p in pieces if s < 0)
        shared = [p for s, p in pieces if s >= 0]
        tokens, owner, frequency = (np.concatenate([p[i] for p in shared]) if shared else np.zeros(0, np.uint64) for i in range(3))
        owner, size = owner.astype(np.int64), counts.astype(np.int64)
        own = size - np.bincount(owner, minlength=len(size))
        hopeful = (size > 0) & (own <= np.array([tolerated(int(x), t) for x in size]))
        compact = np.cumsum(hopeful) - 1
        inside = hopeful[owner]
        tokens, owner, frequency = tokens[inside], compact[owner[inside]], frequency[inside].astype(np.int64)
        ids, size, own = ids[hopeful].view(np.int64), size[hopeful], own[hopeful]
        by, found = signatures(owner, tokens, frequency, size, t)
        order = np.lexsort((found, by))
        by, found = by[order], found[order].view(np.int64)
        new = np.ones(len(by), bool)
        new[1:] = (by[1:] != by[:-1]) | (found[1:] != found[:-1])
        by, found = by[new], found[new]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(by, np.arange(len(ids) + 1)), pa.int32()), pa.array(found))
        order = np.lexsort((tokens, owner))
        bounds, tokens = np.searchsorted(owner[order], np.arange(len(ids) + 1)), tokens[order]
        sets = [blobs.encode([tokens[bounds[i] : bounds[i + 1]]], (0,)) for i in range(len(ids))]
        return pa.table(
            [pa.array(ids), pa.array(size, pa.int32()), pa.array(own, pa.int32()), pa.array(sets, pa.binary()), lists], names=["doc_id", "size", "own", "tokens", "signatures"]
        )

    pieces = rows.mapInArrow(lambda batches: lean_stream(send, batches), "slice int, block bigint, piece binary")
    # The documents of a block travel under a key of their own, so that no slice gathers them all.
    keyed = pieces.withColumn("at", F.when(F.col("slice") < 0, -1 - F.col("block")).otherwise(F.col("slice").cast("bigint")))
    shared = keyed.groupBy("at").applyInArrow(lambda g: lean_group(find_shared, g), "block bigint, slice int, piece binary")
    return shared.groupBy("block").applyInArrow(lambda g: lean_group(sign, g), "doc_id bigint, size int, own int, tokens binary, signatures array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches t, written."""
    pairs = _small(materialise(pairs, "pairs"))
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("tokens").alias(f"tokens_{x}")).join(pairs, x)
    both = side("a").join(side("b"), ["a", "b"]).where(F.least("size_a", "size_b") >= F.lit(t) * F.greatest("size_a", "size_b") - 1e-9)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size_a"), np.int64) + np.asarray(batch.column("size_b"), np.int64)
            common = np.zeros(len(size), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
                common[i] = len(np.intersect1d(blobs.decode(x.as_py())[0], blobs.decode(y.as_py())[0], assume_unique=True))
            keep = pa.array(np.flatnonzero(common >= t * (size - common) - 1e-9))
            yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return materialise(both.mapInArrow(lambda batches: lean_stream(check, batches), "a bigint, b bigint"), "joined", batch=BATCH_ROWS)


def _placed(places: DataFrame, known: DataFrame) -> DataFrame:
    """The lists (list_id, weight, node, size, shared, root) of which not all nodes are in one component, roots brought up to date."""
    rows = materialise(places.drop("root").join(_small(known), "node", "left").withColumn("root", F.coalesce("root", "node")), "places")
    mixed = materialise(rows.groupBy("list_id").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list_id"), "mixed-lists")
    return materialise(rows.join(_small(mixed), "list_id"), "places")


def _may_join(a: str, b: str, t: float):
    """Whether two different sets could reach t by their sizes and by how many of their tokens are shared with any other set."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"), F.when(x == y, x - 1).otherwise(F.least(x, y)))
    return most >= F.lit(t) * (x + y - most) - 1e-9


def _promising(placed: DataFrame, turn: int, t: float) -> DataFrame:
    """For each component, two candidates (a, b) in others: that with which it shares most signatures, and any.

    In a list, the nodes of other components are tried with one node, another each turn; a
    large component is likely to give it.
    """
    member = F.struct("node", "size", "shared", "root")
    chance = F.xxhash64("list_id", "node", F.lit(turn))
    single = (F.col("list_id").bitwiseAND(F.lit(1)) == 1) & (F.col("size") > 1)  # lists of documents of one token are represented by that
    pivots = placed.groupBy("list_id").agg(F.min_by(member, F.struct(single, chance)).alias("a"))
    apart = placed.select("list_id", "weight", member.alias("b")).join(pivots, "list_id").where("a.root <> b.root").where(_may_join("a", "b", t))
    weighed = apart.groupBy(F.col("b.root").alias("root"), F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.sum("weight").alias("weight"))
    pair, some = F.struct("a", "b"), F.xxhash64("a", "b", F.lit(turn))
    best = weighed.groupBy("root").agg(F.max_by(pair, F.struct("weight", some)).alias("p"), F.max_by(pair, some).alias("q"))
    both = best.select(F.explode(F.array("p", "q")).alias("p"))
    return both.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()


def _apart(placed: DataFrame, t: float) -> DataFrame:
    """Every candidate (a, b) whose sides are in different components and could reach t."""
    star = F.col("list_id").bitwiseAND(F.lit(1)) == 1
    hubs = placed.where(star & (F.col("size") == 1))
    found = []
    for left, right in ((placed.where(~star), placed.where(~star)), (hubs, placed.where(star))):
        pairs = left.alias("l").join(right.alias("r"), "list_id").where(F.col("l.root") != F.col("r.root")).where(_may_join("l", "r", t))
        found.append(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")))
    return found[0].where("a < b").unionByName(found[1]).distinct()


def joined_sets(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, components): (set_id, doc_id) of every document that may have a partner, the sets, and (node, root) of those that join another.

    Equal sets, all of whose tokens are shared, are one set.
    """
    if not 0.5 <= t <= 1:
        raise ValueError("the threshold is from 0.5 to 1")
    content = ["tokens", "size", F.when(F.col("own") > 0, F.col("doc_id"))]
    index = materialise(indexed(docs, n, t).withColumn("k1", F.xxhash64(*content)).withColumn("k2", F.xxhash64(F.lit(1), *content)), "signed", free=True, batch=BATCH_ROWS)
    owners = materialise(index.select("k1", "k2", "doc_id").distinct(), "set-members")
    sets = materialise(
        index.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("size", "own", "tokens", "signatures")])
        .join(owners.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")), ["k1", "k2"]).withColumn("set_id", F.monotonically_increasing_id()),
        "sets",
        free=True,
    )
    members = owners.join(sets.select("k1", "k2", "set_id"), ["k1", "k2"]).select("set_id", "doc_id")
    signed = sets.select(F.col("set_id").alias("node"), F.explode("signatures").alias("s"))
    # Most signatures of a group are shared by the same sets: of those, known by a fingerprint, one is kept with how many there are.
    sharers = signed.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    lists = materialise(sharers.groupBy("n", "x", "y", F.col("s").bitwiseAND(F.lit(1))).agg(F.min("s").alias("list_id"), F.count(F.lit(1)).alias("weight")).select("list_id", "weight"), "lists")
    nodes = sets.select(F.col("set_id").alias("node"), "size", (F.col("size") - F.col("own")).alias("shared"), F.col("set_id").alias("root"), F.explode("signatures").alias("list_id"))
    placed = materialise(nodes.join(_small(lists), "list_id"), "places")
    edges, turn = None, 0
    while True:  # each round joins components through their most promising candidates
        pairs = materialise(_promising(placed, turn, t), "promising")
        found = verified(pairs, sets, t)
        edges = found if edges is None else edges.unionByName(found)
        placed, turn = _placed(placed, components(edges)), turn + 1
        if found.count() <= YIELD * pairs.count() or placed.isEmpty():
            break
    # What is still apart and could join is verified in full.
    return members, sets, components(edges.unionByName(verified(_apart(placed, t), sets, t)))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left has in common with each of right."""
    every = np.concatenate([*left, *right])
    _, column, frequency = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    found = np.zeros((len(left), len(right)), np.float32)
    keep = frequency[column] > 1
    row, column = row[keep], column[keep]
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    few = frequency[column] <= COMMON
    r, c = row[few], column[few]
    for step in range(1, COMMON):
        same = np.flatnonzero(c[step:] == c[:-step]) if step < len(c) else np.zeros(0, np.int64)
        if not len(same):
            break
        x, y = r[same], r[same + step]  # in order, so left comes first
        across = (x < len(left)) & (y >= len(left))
        found += np.bincount(x[across] * len(right) + y[across] - len(left), minlength=found.size).reshape(found.shape)
    r, c = row[~few], np.unique(column[~few], return_inverse=True)[1]
    for a in range(0, int(c.max()) + 1 if len(c) else 0, 2048):
        some = slice(*np.searchsorted(c, [a, a + 2048]))
        dense = np.zeros((len(left) + len(right), 2048), np.float32)
        dense[r[some], c[some] - a] = 1
        found += dense[: len(left)] @ dense[len(left) :].T
    return found


def links_of_sets(sets: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """(set_id, links): with how many documents of other sets of its component each set joins."""
    placed = sets.select(F.col("set_id").alias("node"), "size", "tokens", "copies").join(known, "node")
    large = materialise(known.groupBy("root").count().where(F.col("count") > CELL), "large-components")
    placed = placed.join(_small(large), "root", "left").withColumn("cells", F.coalesce(F.ceil(F.col("count") / CELL).cast("int"), F.lit(1)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    task = ["root", "i", "j"]
    placed = placed.select("node", "size", "tokens", "copies", "root", "cell", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.whole(batches, task):
            bounds = runs.bounds(table, task)
            out = [_links(table.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["set_id", "links"])

    def _links(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, size, copies, mine = (np.asarray(cell.column(c), np.int64) for c in ("node", "size", "copies", "cell"))
        tokens = [blobs.decode(x)[0] for x in cell.column("tokens").to_pylist()]
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        a = np.flatnonzero(mine == i)
        b = a if i == j else np.flatnonzero(mine == j)
        links = np.zeros(len(node), np.int64)
        if len(a) and len(b):
            common = _common([tokens[x] for x in a], [tokens[x] for x in b])
            near = common >= t * (size[a][:, None] + size[b][None, :] - common) - 1e-9
            if i == j:
                np.fill_diagonal(near, False)
                links[a] = near @ copies[b]
            else:
                links[a], links[b] = near @ copies[b], near.T @ copies[a]
        return node, links

    return runs.together(placed, task).mapInArrow(count, "set_id bigint, links bigint").groupBy("set_id").agg(F.sum("links").alias("links"))


def near_duplicate_groups(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, links: bool = True) -> DataFrame:
    """(doc_id, group_id, group_size, n_links) of every document that joins another, directly or through others.

    group_id is the lowest doc_id of the group, n_links the number of documents it joins directly; without links, that column is left out.
    """
    members, sets, known = joined_sets(docs, n, t)
    grouped = members.join(known, members["set_id"] == known["node"], "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    grouped = materialise(grouped, "grouped")
    sized = grouped.groupBy("root", "doc_id").agg(F.count(F.lit(1))).groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id")).where("group_size > 1")
    if not links:
        return grouped.select("root", "doc_id").distinct().join(sized, "root").select("doc_id", "group_id", "group_size")
    linked = sets.select("set_id", "copies").join(links_of_sets(sets, known, t), "set_id", "left")
    linked = linked.select("set_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    each = grouped.join(linked, "set_id").groupBy("root", "doc_id").agg(F.sum("links").alias("n_links"))
    return each.join(sized, "root").select("doc_id", "group_id", "group_size", "n_links")


def keep_one_of_each(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """The documents without those that are near an other of a lower doc_id in their group; of rows repeated in full, one."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    groups = near_duplicate_groups(docs, n, t, links=False)
    doc_id, other = integral(docs, "doc_id"), fresh(docs, "other")
    drop = materialise(groups.where("doc_id <> group_id").select(F.col("doc_id").alias(other)), "near-duplicates")
    kept = docs.join(_small(drop), doc_id == F.col(other), "left_anti")
    again = materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(other)), "repeated")
    if again.isEmpty():
        return kept.select(*names)
    once = kept.join(again, kept["doc_id"] == F.col(other), "left_anti")
    twice = kept.join(again, kept["doc_id"] == F.col(other), "left_semi")
    return once.select(*names).unionByName(twice.select(*names).dropDuplicates())


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i:i + {NGRAM} - 1], ' '))
                                      ELSE [array_to_string(w, ' ')] END) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common >= {THRESHOLD} * (na.n + nb.n - common)),
edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
grouped AS (SELECT node AS doc_id, min(other) AS group_id FROM reach GROUP BY node)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, (SELECT count(*) FROM edge WHERE a = doc_id) AS n_links FROM grouped
"""
