"""From raw documents to segmented training text, in stages that each read what the last one wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, langid, merge_dropout, repeats, simhash
from eventloom.llm.common import prepare, read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, with that language in ``lang``."""
    prepare(spark)
    return langid.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of exact and near copies."""
    return simhash.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stood somewhere earlier."""
    return repeats.without_repeats(docs)


def without_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that occurrences of benchmark windows cover."""
    return decontaminate.cut_passages(docs, read_table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, their count, and whether these decode to the text."""
    prepare(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return merge_dropout.segment(docs, model, restored="_decoded").select(
        *COLUMNS, "ids", F.size("ids").cast("bigint").alias("n_ids"),
        F.col("text").eqNullSafe(F.col("_decoded")).alias("lossless"),
    )


STAGES = [
    ("language ID", known_language),
    ("near copies", without_near_copies),
    ("repeated strings", without_repeats),
    ("test passages", without_test_passages),
    ("pieces", segmented),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each stage's rows are written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
