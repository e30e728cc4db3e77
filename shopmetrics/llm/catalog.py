"""The registered queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_naming,
    bpe,
    chosen_path,
    conversation_repair,
    decontaminate,
    hard_negatives,
    kneser_ney,
    language_id,
    ngram_join,
    repeats,
    sharding,
    training_order,
    url_reputation,
)
from .frames import read_table, scratch_path, python_ready
from .oracle import oracle_sql as oracle_sql

SHARDS = 40
# The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is 0; a null id reads as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == 0


def hex_of(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    out = bpe.encode_and_decode(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "n_tokens", hex_of(F.col("ids")).alias("ids_sha256"), hex_of(F.col("decoded")).alias("decoded_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    out = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), least=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", hex_of(F.col("kept")).alias("kept_sha256"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    encode, dtype = training_order.bpe_ids(spark, vocabulary_path())
    return training_order.write_training_order(read_table(spark, sf_dir, "documents"), scratch_path(spark, "training-order-shards"), encode=encode, dtype=dtype)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    return ngram_join.near_groups(read_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"), 5)))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~held_out(F.col("doc_id"), 10)))
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    return chosen_path.near_copies(read_table(spark, sf_dir, "documents"), width=5, percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    return conversation_repair.repair(conversation_repair.damage(read_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), anchor=F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_suffix_array_dedup, op3_training_order, op4_sharding, op5_url_reputation, op6_ngram_join, op7_language_id, op8_kneser_ney, op9_block_naming, op10_decontaminate, op11_chosen_path, op12_conversation_repair, op13_hard_negatives)
    return {f.__name__: f for f in own}
