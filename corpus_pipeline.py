"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage decides row by row, so rows of one id or of none don't speak for each other. Null texts pass the filters as
empty ones; an empty table passes all stages but the first, which needs labelled documents to learn from."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tapestride.llm import decontaminate, exact_dedup, near_join, packing, toxicity
from tapestride.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels of these documents, rejects go."""
    return toxicity.drop_flagged(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of near copies hold together stays, so of a chain of edits one end only."""
    return near_join.one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier, the forest and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's folder goes once the next one is written, the last one's when the session ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(out := f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
            docs = spark.read.parquet(out)
            if before:
                remove(spark, before)
            before = out
    if before:
        atexit.register(remove, spark, before)
    return docs
