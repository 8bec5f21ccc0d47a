"""Corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

1. toxicity: documents that the classifier chain rejects go.
2. near duplicates: of each group of rows linked by shingle sets, one with the smallest doc_id stays (null is last).
3. repeated substrings: bytes covered by 50-byte strings of earlier documents go from the texts; a text of
   which nothing is left goes as a document. A character that a cut goes through goes with it.
4. decontamination: documents in which a window of a benchmark item occurs go.
5. packing: what is left is packed into windows of tokens; this returns the pieces.

Stages 1 to 4 return the columns of documents; n_chars follows the text where it is changed. Rows with null
doc_id pass stage 3 as they are. Columns beside doc_id, text and n_chars go through each stage under names of their own, so none can clash
with what an operator adds. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from voltlake.llm.common import bounded, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of a table of row keys up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Columns that stages read.
OWN = ("doc_id", "text", "n_chars")


def shielded(stage: Stage) -> Stage:
    """The stage on the columns OWN and ``_0``, ``_1``, ... for all others, whose names come back behind it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [c if c in OWN else f"_{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*names)

    return run


@shielded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.chain_for(spark, docs, sf_dir)
    return toxicity.score_toxicity(docs, chain).filter("not toxic")


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # rows are told apart by id and text, as ids repeat and may be null
    found = staged(jaccard_join.near_duplicates(rows, "key").filter("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), "component_id").count(), "linked")
    first = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    kept = found.join(rows.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(first)
    gone = bounded(staged(found.join(kept, "component_id").filter("key <> first").select("key"), "gone"), BROADCAST_ROWS)
    again = bounded(staged(found.filter("count > 1").select("key"), "again"), BROADCAST_ROWS)
    rows = rows.join(gone, "key", "left_anti")
    once = rows.join(again, "key", "left_semi").dropDuplicates(["key"])
    return rows.join(again, "key", "left_anti").unionByName(once)


@shielded
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_substrings(docs, as_text=True).filter("n_removed = 0 or n_removed < n_bytes")
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut


@shielded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    keys = bounded(staged(hits.select(F.col("k").alias("key")).distinct(), "contaminated"), BROADCAST_ROWS)
    return docs.withColumn("key", decontaminate.row_key("doc_id", "text")).join(keys, "key", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return staged(packing.pack(docs), "packed")  # written in small batches


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifiers and tokenizers can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
