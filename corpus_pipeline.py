"""A training-corpus pipeline from the operators: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import block_naming, bpe, decontaminate, language_id, ngram_join
from shopmetrics.llm.catalog import vocabulary_path
from shopmetrics.llm.frames import materialize, python_ready, read_table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows; a text that is null, has no letter or is in none of the languages goes.

    The bound beyond which a text is in none is learned with the model, from labelled texts that it was not fitted on
    (see ``language_id``). If no row has a ``lang``, there is no classifier, and all texts with a letter stay.
    """
    python_ready(spark)
    return language_id.keep_known(docs, language_id.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest id; a null text is an empty one, an empty table stays empty."""
    return block_naming.keep_first_of_equals(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 80 % of common five-word runs; texts without words, or null, stay."""
    python_ready(spark)
    return ngram_join.keep_first_of_groups(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows; null texts stay, repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, repeated rows each, and the digest of what they decode to; a null text has none."""
    python_ready(spark)
    out = bpe.encode_and_decode(docs, vocabulary_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("decontaminate", decontamination),
    ("bpe", tokens),
]

# The classifier is fitted, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
