"""The corpus pipeline: documents that are not toxic, not copies, not near copies and not contaminated, packed.

Each stage reads its predecessor's rows from Parquet and calls one operator on all of them. The stages before the last
return the columns of documents as they came, whatever further columns the table has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.llm import decontaminate, exact_dedup, packing, similar, toxicity
from pairsignal.llm.common import hinted, lower_ascii, read, row_key, settle, text_of
from pairsignal.session import ensure_checkpoint_dir


def _whole(docs: DataFrame, key: Column) -> DataFrame:
    """A row's columns as one, beside its key: no column of docs can clash with a stage's own."""
    return docs.select(key.alias("key"), F.struct("*").alias("row"))


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    return _whole(docs, key).join(hinted(settle(dropped.select("key"))), "key", "left_anti").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    key = row_key(F.col("doc_id"), F.col("text"))
    scored = toxicity.score(docs.select("doc_id", "text", key.alias("key")), read(spark, sf_dir, "labels"), keep=("key",))
    return _without(docs, key, scored.filter("rejected").select("key").distinct())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; of rows that are equal in id and text, one."""
    named = exact_dedup.deduplicate(docs)
    verdicts = settle(
        named.groupBy(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    )
    key = row_key(F.col("doc_id"), F.sha2(lower_ascii(text_of()), 256))
    plain = _without(docs, key, verdicts.filter("not kept or n > 1"))
    again = verdicts.filter("kept and n > 1")
    if not again.limit(1).count():
        return plain
    repeated = _whole(docs, key).join(hinted(again.select("key")), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return plain.unionByName(repeated)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    groups = similar.near_groups(docs)
    return _without(docs, row_key(F.col("doc_id"), F.col("text")), groups.filter("not kept"))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the limit."""
    marked = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, row_key(F.col("doc_id"), F.col("text")), marked.filter("contaminated").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", contaminated),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # a classifier and a tokenizer have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet into the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
