"""The training-data pipeline over ``documents``.

Each stage reads all that the one before it kept; its result is written as
Parquet and read again.  All but the last return the columns of
``documents``; the last returns the places of the packed pieces.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staysignal.llm import op2_substring, op4_packing, op8_toxicity, op9_exact, op10_chosenpath  # noqa: E402
from staysignal.llm.common import table, written  # noqa: E402
from staysignal.session import ensure_checkpoint_dir  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ensure_checkpoint_dir(spark)
    return op8_toxicity.reject(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-equal texts the one with the largest doc_id stays."""
    ensure_checkpoint_dir(spark)
    return op9_exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ensure_checkpoint_dir(spark)
    return op10_chosenpath.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier go; a text that loses
    nothing stays as it is, letter for letter.  ``n_chars`` follows the text."""
    ensure_checkpoint_dir(spark)
    out = op2_substring.substring_dedup(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    ensure_checkpoint_dir(spark)
    return op4_packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
          ("substring dedup", repeated_passages), ("best-fit packing", packing)]

#: Byte-level BPE and a trained classifier have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
