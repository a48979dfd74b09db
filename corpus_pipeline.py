"""From raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before
kept, and returns the columns of ``documents`` (the last one pieces).  Models are
fitted on the labelled rows of the tables in ``sf_dir``.  Stages handle what their
operators do: null and empty texts count as empty (the rules reject them),
repeated rows count as copies, empty tables stay empty, and further columns are
carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import table, written
from lakeloom.llm.near_dups import keep_one_of_each
from lakeloom.llm.packing import pack
from lakeloom.llm.pii import fit, redact
from lakeloom.llm.quality_ranking import fit_ranking, keep_preferred
from lakeloom.llm.quality_rules import fit_forest, keep_passing
from lakeloom.llm.queries import held_out, tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that score below one half."""
    ranking = fit_ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=~held_out())
    return keep_preferred(docs, ranking)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that a rule fails or the forest finds anomalous.

    The forest is fitted on all labels, also on those that the classifier holds out.
    """
    return keep_passing(docs, fit_forest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays."""
    return keep_one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    return redact(docs, fit(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express none of the learned stages; the tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
