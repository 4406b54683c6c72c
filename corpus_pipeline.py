"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. The first four return the
columns of documents; the last returns the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
Rows without doc_id pass every filter but the quality rules, and are never taken for copies of others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faceoff.llm import jaccard, packing, quality, secrets, substring
from faceoff.llm.registry import table
from faceoff.llm.scratch import Scratch


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio accept."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    first = jaccard.jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    stay = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that occur earlier."""
    return _measured(substring.remove_duplicates(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind."""
    return _measured(secrets.redact(docs, secrets.fit(docs)))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_copies), ("substring_dedup", repeated_passages),
          ("secret_scans", secret_scans), ("best_fit_packing", packing_)]

#: The stages are beyond SQL; tests/llm/test_pipeline.py checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
