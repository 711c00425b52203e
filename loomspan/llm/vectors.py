"""Near duplicates among embeddings: every pair at or above a cosine.

Vectors are normalised to unit length; equal ones are folded first.  The join is exact:

* Each vector belongs to the nearest of a sample of the vectors, its pivot, at an angle r.
* If x and y are no more than the threshold's angle apart and r(x) <= r(y), then the angle between y and x's pivot is at
  most that angle and r(x), so y is compared with the vectors of a pivot only where it can meet one of a lower r.  Which of the two
  has the lower r decides where a pair is counted, so none is counted twice, and none is ever written out.
* Vectors are written to blocks of at most CELL, sorted by pivot; each task reads the blocks it compares by path.  A pivot with many
  vectors has several blocks, so none has a cap on its vectors.
* Comparisons in single precision leave out only pairs that cannot reach the threshold for any rounding; the others are computed in
  double precision.

Without structure in the vectors this is work in proportion to some share of all pairs.  How small a share follows from how
close the pivots are: one in PER_PIVOT of the vectors is one, up to PIVOT_VALUES numbers.

``recall`` below 1 gives the join by Euclidean p-stable hashing instead, which misses pairs; no query uses it.  Vectors are projected on
Gaussian directions, shifted and cut into cells of width ``WIDTH``.  ``k`` cells make the bucket of one table; vectors
that share a bucket in any of ``l`` tables are candidates and are compared exactly.  ``k`` and ``l`` follow from the table itself.  k gives a
vector about CHANCE unrelated candidates (cosine 0) in one table, so they stay in proportion to rows; l makes a pair exactly
at the threshold meet with a chance of ``recall``, and closer pairs more surely.  Into the buckets go sketches of SKETCH sign bits;
a vector is fetched into a bucket only if its sketch differs from that of another one there by no more than
pairs at the threshold do (but for a chance of about 1e-15).  A pair is counted where it is the first table it shares.  Buckets of more than
CELL members are cut into cells by a hash of the member, and each pair of cells is a task of its own.

The result has one row for each vector that has a near one: its class, which is the connected component, and the
number of its links.

Defined cases
* null vectors, null elements, NaN or infinity, zero vectors and null ids: linked with nothing
* vectors of different lengths are never linked
* rows repeated with id and vector: one; an id with several vectors: a row for each of them
* equal vectors, also vectors that differ by a factor, are linked like any other pair
* ties do not matter: every pair at or above the threshold is a link
* empty table: no rows; extra columns, whatever their names, are ignored; ids keep their type
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .components import components
from .store import local_path, materialise, partitions, scratch

THRESHOLD, WIDTH, RECALL, SEED = 0.95, 2.0, 0.97, 11
CHANCE = 16
SKETCH = 128
CELL = 4096
#: Vectors for each pivot, and the numbers that all pivots and a block may have.
PER_PIVOT, PIVOT_VALUES, BLOCK_VALUES = 64, 1 << 21, 1 << 20
#: Blocks that a task compares with one at most.
STRIP = 64


def _phi(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash puts two vectors at this distance in one cell."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(hashes a table, tables)."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2.0))
    k = max(1, math.ceil(math.log(max(rows / CHANCE, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k))) if near < 1 else 1


def most_differing(threshold: float) -> int:
    """Sign bits of SKETCH in which a pair at the threshold differs at most: eight standard deviations above the mean."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + 8 * math.sqrt(SKETCH * p * (1 - p))))


@functools.lru_cache(maxsize=8)
def _projections(dims: int, k: int, l: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dims, l * k) directions and (l * k) shifts."""
    random = np.random.default_rng([seed, dims])
    drawn = [(random.standard_normal((dims, k)), random.uniform(0, WIDTH, k)) for _ in range(l)]
    return np.concatenate([d for d, _ in drawn], axis=1), np.concatenate([s for _, s in drawn])


def bucket_keys(vectors: np.ndarray, k: int, l: int, seed: int = SEED) -> np.ndarray:
    """(rows, l) bucket keys of unit vectors."""
    directions, shift = _projections(vectors.shape[1], k, l, seed)
    cells = np.floor((vectors @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), l, k)
    h = np.tile(np.arange(1, l + 1, dtype=np.uint64), (len(vectors), 1))
    for j in range(k):
        h = (h ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def sketches(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(rows, SKETCH / 64) words of sign bits."""
    directions = np.random.default_rng([seed, 1, vectors.shape[1]]).standard_normal((vectors.shape[1], SKETCH))
    return np.packbits(vectors @ directions > 0, axis=1).view(np.uint64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrices(batch: pa.RecordBatch | pa.Table, plain: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length of vectors in a batch."""
    packed = batch.column("packed").to_pylist()
    sizes = np.array([len(p) for p in packed]) // np.dtype(plain).itemsize
    for d in np.unique(sizes):
        mine = np.flatnonzero(sizes == d)
        yield mine, _unit(np.frombuffer(b"".join(packed[m] for m in mine), plain).reshape(-1, d).astype(np.float64))


def _unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the components of p and q; root holds the lowest member of each one's component before and after."""
    while True:
        apart = root[p] != root[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return
        np.minimum.at(root, np.maximum(root[p], root[q]), np.minimum(root[p], root[q]))
        while (root[root] != root).any():
            root[:] = root[root]


def _rounding(dims: int) -> float:
    """By how much a product of unit vectors in single precision may be wrong."""
    return (dims + 8) * 2.0**-23


class Block:
    """Vectors of one length, sorted by pivot, with the runs of equal pivots."""

    def __init__(self, path: str, plain: type):
        with pa.memory_map(path) as file:
            table = pa.ipc.open_file(file).read_all()
            self.rep, self.copies, self.home, self.angle = (np.array(table.column(c)) for c in ("rep", "copies", "home", "angle"))
            self.exact = next(_matrices(table, plain))[1]
        self.single = self.exact.astype(np.float32)
        self.bounds = runs.bounds(table.select(["home"]), ["home"])
        self.radius = np.maximum.reduceat(self.angle, self.bounds[:-1])


def _near_pairs(x: Block, y: Block, pivots: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q) of x and y whose cosine reaches the threshold and of which p is nearer to its pivot."""
    rounding, apart = _rounding(x.exact.shape[1]), math.acos(max(-1.0, min(1.0, threshold - 1e-9)))
    within = lambda angle: np.cos(np.minimum(angle + apart, math.pi))
    reach = np.maximum(within(x.radius)[:, None], within(y.angle)[None, :]) - rounding - 1e-6
    met = pivots[x.home[x.bounds[:-1]]].astype(np.float32) @ y.single.T >= reach
    for some, begin, end in zip(met, x.bounds, x.bounds[1:], strict=False):
        some = np.flatnonzero(some)
        if not len(some):
            continue
        others = y.single[some].T
        for a in range(begin, end, 512):
            p, q = np.nonzero(x.single[a : min(end, a + 512)] @ others >= threshold - 1e-12 - rounding)
            p, q = p + a, some[q]
            first = (x.angle[p] < y.angle[q]) | ((x.angle[p] == y.angle[q]) & (x.rep[p] < y.rep[q]))
            p, q = p[first], q[first]
            for b in range(0, len(p), 1 << 18):
                r, s = p[b : b + (1 << 18)], q[b : b + (1 << 18)]
                near = np.einsum("ij,ij->i", x.exact[r], y.exact[s]) >= threshold - 1e-12  # unit vectors are exact to some 1e-16
                yield r[near], s[near]


def _exact_links(folded: DataFrame, rows: int, threshold: float, plain: type) -> DataFrame:
    """(rep, links, to): links of vectors counted by tasks, and edges that connect what is linked."""
    spark = folded.sparkSession
    values = folded.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    rate = max(PER_PIVOT, -(-values // np.dtype(plain).itemsize // PIVOT_VALUES))
    sample = folded.where(F.pmod(F.xxhash64("h"), F.lit(rate)) == 0).select("packed").toArrow()
    pivots = {u.shape[1]: u for _, u in _matrices(sample, plain)}
    cell, strip = CELL, STRIP

    def pivots_of(dims: int) -> np.ndarray:
        return pivots[dims] if dims in pivots else np.eye(1, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, u in _matrices(batch, plain):
                near, single = pivots_of(u.shape[1]), u.astype(np.float32)
                home, most = np.zeros(len(u), np.int32), np.full(len(u), -np.inf, np.float32)
                for a in range(0, len(u), 2048):
                    for b in range(0, len(near), 4096):
                        cosine = single[a : a + 2048] @ near[b : b + 4096].T.astype(np.float32)
                        best = cosine.argmax(axis=1)
                        at = cosine[np.arange(len(best)), best]
                        better = at > most[a : a + 2048]
                        home[a : a + 2048][better], most[a : a + 2048][better] = best[better] + b, at[better]
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", u, near[home]), -1, 1))
                taken = batch.select(["rep", "copies", "packed"]).take(pa.array(mine))
                columns = [*taken.columns, pa.array(np.full(len(u), u.shape[1], np.int32)), pa.array(home), pa.array(angle)]
                yield pa.record_batch(columns, names=["rep", "copies", "packed", "dims", "home", "angle"])

    columns = "rep bigint, copies bigint, packed binary, dims int, home int, angle double"
    placed = materialise(folded.select("rep", "copies", "packed").mapInArrow(assign, columns), "near-pivots")
    large = materialise(placed.groupBy("dims", "home").count().where(F.col("count") > CELL), "large-pivots")
    part = F.pmod(F.xxhash64("rep"), F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1))).cast("int")
    placed = placed.join(large, ["dims", "home"], "left").withColumn("part", part).drop("count")
    folder = local_path(scratch(spark, "vector-blocks"))
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, size, dims = 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            name = f"{TaskContext.get().partitionId()}-{made}"
            temporary = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
            with pa.ipc.new_file(temporary, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held))
            os.replace(temporary, os.path.join(folder, name))
            made, held, size = made + 1, [], 0
            return pa.record_batch([pa.array([dims], pa.int32()), pa.array([name])], names=["dims", "name"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = runs.bounds(pa.Table.from_batches([batch]), ["dims"]).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                if held and batch.column("dims")[a].as_py() != dims:
                    yield flush()
                dims = batch.column("dims")[a].as_py()
                most = max(1, min(cell, BLOCK_VALUES // dims))
                while a < b:
                    some = batch.slice(a, min(b - a, most - size))
                    held.append(some)
                    a, size = a + some.num_rows, size + some.num_rows
                    if size == most:
                        yield flush()
        if held:
            yield flush()

    writers = min(partitions(spark), max(1, rows // (4 * CELL)))
    placed = placed.repartition(writers, "dims", "home", "part").sortWithinPartitions("dims", "home", "part", "rep")
    written = placed.select("rep", "copies", "packed", "dims", "home", "angle").mapInArrow(write, "dims int, name string").collect()
    names = {}
    for dims, name in sorted(map(tuple, written)):
        names.setdefault(dims, []).append(name)
    # A task compares a block with a strip of blocks of the same length; tasks are numbered through all lengths.
    strip = min(strip, max(1, sum(len(n) ** 2 for n in names.values()) // (16 * partitions(spark))))
    strips = {d: -(-len(n) // strip) for d, n in names.items()}
    lengths = sorted(names)
    ends = np.cumsum([len(names[d]) * strips[d] for d in lengths], dtype=np.int64)
    tasks = int(ends[-1]) if len(ends) else 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = functools.lru_cache(maxsize=2)(lambda name: Block(os.path.join(folder, name), plain))
        for batch in batches:
            for task in batch.column(0).to_pylist():
                at = int(np.searchsorted(ends, task, "right"))
                dims = lengths[at]
                mine, i = names[dims], (task - (int(ends[at - 1]) if at else 0)) // strips[dims]
                begin = (task - (int(ends[at - 1]) if at else 0)) % strips[dims] * strip
                x = load(mine[i])
                for j in range(begin, min(begin + strip, len(mine))):
                    y = x if i == j else Block(os.path.join(folder, mine[j]), plain)
                    rep, copies = (x.rep, x.copies) if i == j else (np.concatenate((x.rep, y.rep)), np.concatenate((x.copies, y.copies)))
                    shift = 0 if i == j else len(x.rep)
                    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
                    for p, q in _near_pairs(x, y, pivots_of(dims), threshold):
                        q = q + shift
                        np.add.at(links, p, copies[q])
                        np.add.at(links, q, copies[p])
                        _unite(root, p, q)
                    some = np.flatnonzero(links)
                    if len(some):
                        yield pa.record_batch([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "to"])

    numbers = spark.range(0, tasks, 1, max(1, min(tasks, 4 * partitions(spark))))
    return numbers.mapInArrow(compare, "rep bigint, links bigint, to bigint")


#: A task's share of a bucket: the table, the bucket, and the two cells of it that are compared.
TASK = ["dims", "t", "key", "i", "j"]


def _hashed_links(folded: DataFrame, rows: int, threshold: float, recall: float, plain: type) -> DataFrame:
    """As _exact_links, but for pairs that share no bucket."""
    k, l = tables_for(rows, threshold, recall)

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = np.asarray(batch.column("rep"))
            for mine, u in _matrices(batch, plain):
                keys, words = bucket_keys(u, k, l), sketches(u)
                many = lambda x: pa.array(np.tile(x, l))
                yield pa.record_batch(
                    [many(reps[mine]), pa.array(np.full(len(mine) * l, u.shape[1], np.int32)), pa.array(np.repeat(np.arange(l, dtype=np.int32), len(mine))), pa.array(keys.T.ravel())]
                    + [many(words[:, w].view(np.int64)) for w in range(SKETCH // 64)],
                    names=["rep", "dims", "t", "key", *bits],
                )

    bits = [f"bits{w}" for w in range(SKETCH // 64)]
    bit_columns = ", ".join(f"{b} bigint" for b in bits)
    hashed = folded.select("rep", "packed").mapInArrow(hash_batches, f"rep bigint, dims int, t int, key bigint, {bit_columns}")
    # A bucket's size decides into how many cells it is cut; both are counted on the keys alone.
    large = materialise(hashed.groupBy("dims", "t", "key").count().where(F.col("count") > CELL), "large-buckets")
    if large.isEmpty():
        celled = hashed.select("*", F.lit(0).alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        n_cells = F.coalesce(F.ceil(F.col("count") / CELL).cast("int"), F.lit(1))
        celled = hashed.join(large, ["dims", "t", "key"], "left").withColumn("cells", n_cells).withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
        celled = celled.withColumn("other", other).select("rep", "dims", "t", "key", *bits, "cell", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"))
    most = most_differing(threshold)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a bucket whose sketch is near that of another."""
        for table in runs.whole(batches, TASK):
            bounds = runs.bounds(table, TASK)
            run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            words = np.stack([np.asarray(table.column(b)).view(np.uint64) for b in bits], axis=1)
            cell, apart = np.asarray(table.column("cell")), np.asarray(table.column("i")) != np.asarray(table.column("j"))
            wanted = np.zeros(len(run), bool)
            for step in range(1, int(np.diff(bounds).max())):
                a = np.flatnonzero(run[step:] == run[:-step])
                b = a + step
                close = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= most
                close &= ~apart[a] | (cell[a] != cell[b])
                wanted[a[close]] = wanted[b[close]] = True
            yield from table.select(["rep", *TASK, "cell"]).take(pa.array(np.flatnonzero(wanted))).to_batches()

    task_columns = "dims int, t int, key bigint, i int, j int, cell int"
    sifted = materialise(runs.together(celled, TASK).mapInArrow(sift, f"rep bigint, {task_columns}"), "near-sketches")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, links of it counted here, the rep it is connected to)."""
        for table in runs.whole(batches, TASK):
            bounds = runs.bounds(table, TASK)
            units, keys = [None] * table.num_rows, np.empty((table.num_rows, l), np.int64)
            for mine, u in _matrices(table, plain):
                keys[mine] = bucket_keys(u, k, l)
                for m, x in zip(mine, u, strict=True):
                    units[m] = x
            out = [_links(table.slice(a, b - a), np.stack(units[a:b]), keys[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            reps, links, to = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(reps), pa.array(links), pa.array(to)], names=["rep", "links", "to"])

    def _links(task: pa.Table, u: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reps, copies, cell, t = (np.asarray(task.column(c)) for c in ("rep", "copies", "cell", "t"))
        across = task.column("i")[0].as_py() != task.column("j")[0].as_py()
        links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for a in range(0, len(reps), 1024):
            cosine = u[a : a + 1024] @ u.T
            x, y = np.nonzero(cosine >= threshold - 1e-9)
            x += a
            fits = (x < y) & ((cell[x] != cell[y]) if across else True)
            x, y = x[fits], y[fits]
            for b in range(0, len(x), 1 << 18):
                p, q = x[b : b + (1 << 18)], y[b : b + (1 << 18)]
                near = np.einsum("ij,ij->i", u[p], u[q]) >= threshold - 1e-12  # unit vectors are exact to some 1e-16
                p, q = p[near], q[near]
                _unite(root, p, q)
                first = (keys[p] == keys[q]).argmax(axis=1) == t[0]
                np.add.at(links, p[first], copies[q[first]])
                np.add.at(links, q[first], copies[p[first]])
        return reps, links, reps[root]

    fetched = sifted.join(folded.select("rep", "packed", "copies"), "rep")
    return runs.together(fetched, TASK).mapInArrow(compare, "rep bigint, links bigint, to bigint")


def near_classes(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = 1.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, class_id, n_links) of every vector with one at or above the threshold; class_id is the lowest id of its component.

    Every link is found but with a recall below 1, which hashes and may miss some.
    """
    kinds = dict(embeddings.dtypes)
    id_kind, double = kinds[id_column], kinds[vector_column] != "array<float>"
    plain = np.float64 if double else np.float32
    table = embeddings.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>" if double else "array<float>").alias("v"))
    v = F.col("v")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    table = table.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(usable)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype(plain) + plain(0)  # + 0 makes -0.0 equal to 0.0
            packed = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            hashes = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            yield pa.record_batch([batch.column("id"), pa.array(hashes, pa.binary()), pa.array(packed, pa.binary())], names=["id", "h", "packed"])

    entries = table.mapInArrow(digest, f"id {id_kind}, h binary, packed binary")
    owned = materialise(entries.groupBy("h", "id").agg(F.first("packed").alias("packed")), "vector-rows")
    # Equal vectors are one from here on; the numbers they get are fixed as they are written.
    folded = materialise(
        owned.groupBy("h").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("lowest")).withColumn("rep", F.monotonically_increasing_id()),
        "vectors",
    )
    rows = folded.count()
    found = _exact_links(folded, rows, threshold, plain) if recall >= 1 else _hashed_links(folded, rows, threshold, recall, plain)
    counted = materialise(found, "links")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(counted.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    lowest = roots.join(folded.select(F.col("rep").alias("node"), "lowest"), "node").groupBy("root").agg(F.min("lowest").alias("class_id"))
    classed = folded.select("h", "rep", "copies", "lowest").join(links, "rep", "left").join(roots.join(lowest, "root").select(F.col("node").alias("rep"), "class_id"), "rep", "left")
    classed = classed.select("h", F.coalesce("class_id", "lowest").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0")
    return owned.select("h", "id").join(classed, "h").select(F.col("id").alias(id_column), "class_id", "n_links")


def with_planted_copies(embeddings: DataFrame) -> DataFrame:
    """The embeddings with two near copies of each, under negative ids: one twice as long, one turned by a few degrees."""
    v = F.col("embedding").cast("array<double>")
    base = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding"))
    twice = base.select((-2 * F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    turned = base.select((-2 * F.col("vec_id") - 2).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x * 1.05).otherwise(x * 0.95)).alias("embedding"))
    return base.unionByName(twice).unionByName(turned)


def _sql(source: str) -> str:
    return f"""
WITH RECURSIVE e AS ({source}),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
SELECT node AS vec_id, class_id, (SELECT count(*) FROM edge WHERE a = node) AS n_links FROM classes
"""


_BASE = "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL"
SQL = _sql(_BASE)
SQL_PLANTED = _sql(
    f"SELECT * FROM ({_BASE}) UNION ALL SELECT -2 * vec_id - 1, list_transform(v, lambda x: x * 2) FROM ({_BASE}) "
    f"UNION ALL SELECT -2 * vec_id - 2, list_transform(v, lambda x, i: CASE WHEN i % 2 = 1 THEN x * 1.05 ELSE x * 0.95 END) FROM ({_BASE})"
)
