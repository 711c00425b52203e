"""From raw documents to packed training sequences.

Stages in order; each works on all that its predecessor kept, and all but the last
return whole rows of documents:

1. toxicity: documents that the classifier rejects go
2. near_duplicates: one document of each n-gram Jaccard group stays
3. pii: personal identifiers in the text are masked
4. mixing: sources are mixed to target weights within the token budget
5. packing: documents are packed into sequences (bin_id, example_ids, totals)

Defined cases
* null or empty text: kept by stages 1 to 3; no tokens in the mix; an example of 0 tokens in a sequence
* null doc_id: kept by stages 1 to 3, in the mix like any other, null in its sequence; doc_id is of an integral type, any other raises TypeError
* null source: a source of its own
* rows repeated in full: one is left by stage 2; other rows of one doc_id stay
* very long texts: every stage works on the whole text; a document over the limits is a sequence of its own
* extra columns, whatever their names, are carried up to the packing
* empty documents: no sequences; labels of one class only, or none: ValueError, as nothing can be learned
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import mixing, near_duplicates, packing, pii, toxicity
from loomspan.llm.store import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_pii),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the classifier, the detection of identifiers and the packing; tests/llm/test_pipeline.py
#: holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
