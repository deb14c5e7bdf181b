"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's ``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import _shared, line_dedup, near_dedup, packing, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones, finds clean.

    A NULL or empty text has the score of the bias alone, so it stays where most labels say clean.
    Repeated rows stay or go together; columns pass through; an empty table stays empty.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(machine)(F.col("text")) < 0.5)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds. No row goes: a document that
    repeats earlier ones whole keeps its row with what is left; a NULL text stays NULL."""
    return line_dedup.deduplicate_passages(docs).select("doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first stored; all texts without words
    are one group."""
    return near_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row a piece; a text without words is its end id. Repeated rows are packed
    each, other columns are ignored whatever their names, an empty table gives an empty result."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("line_dedup", unrepeated), ("near_dedup", distinct), ("packing", packed)]

#: Learned scores, winnowing and SimHash can't be put in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
