"""Mixing sources to target weights by weighted fair queueing.

Within its source, each document gets a place in a seeded shuffle and the
virtual finish time ``tokens of the source up to and including it / weight of
the source``.  Sorting everything by finish time interleaves the sources so
that every prefix holds them in proportion to their weights for as long as they
last; the mix is the longest prefix within the token budget.

No window ever spans a source or the whole table.  Cumulative sums are taken in
two levels: per (source, slice of the shuffle) and, after the range sort, per
range; only sums per slice are carried across.  A hot source is therefore as
parallel as any other.

Defined cases
* null text: no tokens; null source: a source of its own; null doc_id: ordered first
* empty text: no tokens, so it shares the finish time of its predecessor
* ties: rows equal in (source, doc_id, tokens) are peers: they are kept or left out together
* a source of weight 0 or less is left out; an unlisted source has ``default_weight``
* very long texts: counted whole; one of more tokens than are left of the budget ends the mix
* empty table: empty mix
* extra columns never matter, whatever their names: the operator reads doc_id, source and text by name; doc_id may be of any type that sorts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, materialise, partitions

WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 1.5}
BUDGET_FRACTION = 0.7
SEED = 17
#: Cutoffs (one row a source) are broadcast up to this many sources; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_tokens(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def _tag(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    listed = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(listed, F.coalesce(source, F.lit(""))), F.lit(float(default)))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    budget_fraction: float = BUDGET_FRACTION,
    budget_tokens: int | None = None,
    seed: int = SEED,
    default_weight: float = 1.0,
) -> DataFrame:
    """(doc_id, source, n_tokens, finish_time, mix_tokens, shuffle_key) of the documents in the mix.

    mix_tokens is the cumulative token count in mix order, so ordering by it
    (then source, shuffle_key, doc_id) replays the mix.
    """
    spark = docs.sparkSession
    slices = min(partitions(spark), 65_536)
    rows = docs.select(
        F.col("doc_id"), F.col("source"), word_tokens(F.col("text")).alias("n_tokens"), _key(F.col("doc_id"), seed).alias("shuffle_key")
    ).withColumn("tag", _tag(F.col("source"))).where(_weight(F.col("source"), weights, default_weight) > 0)
    rows = materialise(
        rows.withColumn("slice", F.floor(F.conv(F.substring("shuffle_key", 1, 4), 16, 10).cast("bigint") * slices / 65_536).cast("int")),
        "mix-rows",
    )
    before = (
        rows.groupBy("tag", "slice")
        .agg(F.sum("n_tokens").alias("slice_tokens"))
        .withColumn("before", F.sum("slice_tokens").over(Window.partitionBy("tag").orderBy("slice")) - F.col("slice_tokens"))
        .drop("slice_tokens")
    )
    in_slice = Window.partitionBy("tag", "slice").orderBy("shuffle_key", "doc_id", "n_tokens")
    timed = rows.join(before, ["tag", "slice"]).select(
        "doc_id", "source", "tag", "n_tokens", "shuffle_key",
        ((F.col("before") + F.sum("n_tokens").over(in_slice)).cast("double") / _weight(F.col("source"), weights, default_weight)).alias("finish_time"),
    )
    timed = materialise(timed, "mix-timed")
    order = ["finish_time", "tag", "shuffle_key", "doc_id", "n_tokens"]
    ranged = materialise(timed.repartitionByRange(partitions(spark), *order).withColumn("range_id", F.spark_partition_id()), "mix-ranged")
    ranges = ranged.groupBy("range_id").agg(F.sum("n_tokens").alias("range_tokens"))
    whole = Window.partitionBy().orderBy("range_id")  # one row a range: as few rows as there are partitions
    ranges = ranges.select(
        "range_id",
        (F.sum("range_tokens").over(whole) - F.col("range_tokens")).alias("before"),
        F.sum("range_tokens").over(Window.partitionBy()).alias("total"),
    )
    budget = F.lit(int(budget_tokens)) if budget_tokens is not None else F.floor(F.col("total") * F.lit(float(budget_fraction)))
    in_range = Window.partitionBy("range_id").orderBy(*order)
    return (
        ranged.join(ranges, "range_id")
        .withColumn("mix_tokens", F.col("before") + F.sum("n_tokens").over(in_range))
        .where(F.col("mix_tokens") <= budget)
        .select("doc_id", "source", "n_tokens", "finish_time", "mix_tokens", "shuffle_key")
    )


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in the mix, whole rows.

    In each source the mix is a prefix of the shuffle, so one cutoff a source
    decides every row and no text is shuffled.
    """
    seed = options.get("seed", SEED)
    place = lambda key, doc_id, n: F.struct(key.alias("k"), doc_id.alias("d"), n.alias("n"))  # noqa: E731  (nulls compare as the lowest)
    tag, last = fresh(docs, "tag"), fresh(docs, "last")
    mixed = mix_sources(docs, **options)
    cutoffs = materialise(
        mixed.groupBy(_tag(F.col("source")).alias(tag)).agg(F.max(place(F.col("shuffle_key"), F.col("doc_id"), F.col("n_tokens"))).alias(last)),
        "mix-cutoffs",
    )
    if cutoffs.count() <= BROADCAST_SOURCES:
        cutoffs = F.broadcast(cutoffs)
    kept = docs.withColumn(tag, _tag(docs["source"])).join(cutoffs, tag)
    return kept.where(place(_key(F.col("doc_id"), seed), F.col("doc_id"), word_tokens(F.col("text"))) <= F.col(last)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def _sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in WEIGHTS.items())
    return rf"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS BIGINT) AS n_tokens,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle_key
      FROM documents),
    c AS (
      SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY shuffle_key, doc_id, n_tokens) AS DOUBLE)
                / (CASE source {cases} ELSE 1.0::DOUBLE END) AS finish_time
      FROM d),
    m AS (
      SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish_time, source, shuffle_key, doc_id, n_tokens) AS BIGINT) AS mix_tokens,
             sum(n_tokens) OVER () AS total
      FROM c)
    SELECT doc_id, source, n_tokens, finish_time, mix_tokens, shuffle_key
    FROM m WHERE mix_tokens <= floor(CAST(total AS DOUBLE) * {BUDGET_FRACTION}::DOUBLE)
    """


SQL = _sql()
