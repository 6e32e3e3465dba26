"""The training-data pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm import exact_dedup, mil_quality, packing, simhash, suffix_dedup
from netquill.llm._common import col, free_name, set_aside, staged
from netquill.llm.queries import quality_labels

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3
#: Passages of so many words are removed where they repeat.
LEAST_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Empty texts score low and go."""
    model = mil_quality.fit_quality(docs.select("doc_id", "text"), quality_labels(spark, sf_dir))
    name = free_name(docs, "nq_score")
    scored = mil_quality.score_quality(docs, model, docs.columns, name=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*[col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, up to white space: the longest, then the one with the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that repeat; a text may become empty. n_chars follows the text."""
    moved, back = set_aside(docs, suffix_dedup.ADDED)
    got = suffix_dedup.remove_passages(moved, moved.columns, LEAST_WORDS)
    return back(got.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash", near), ("suffix_dedup", passages), ("packing", packed)]

#: SQL has no learned classifier, suffix arrays or bin packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
