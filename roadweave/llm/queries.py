"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, cube_mix, divergence_rules, gru_lm, hard_negatives, jump_shards, lang_hier, learned_partitions, pair_ranking, secret_forest, token_files, whitening
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents"))


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return gru_lm.score(table(spark, sf_dir, "documents"), learn=fold != 0).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return divergence_rules.judge(docs, divergence_rules.references(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.scan(table(spark, sf_dir, "documents"), secret_forest.fit(secret_forest.labelled_findings(spark)))
    return found.select("doc_id", "place", "key", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def op8_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=80)


def op9_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = lang_hier.fit(docs, learn=fold != 1)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return lang_hier.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op11_pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = pair_ranking.fit(docs, table(spark, sf_dir, "labels"), learn=fold != 1)
    return pair_ranking.score(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), keep=16).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0, label=label, positives=5, negatives=10)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_cube_mix, op3_gru_lm, op4_learned_partitions, op5_divergence_rules, op6_bpe, op7_secret_forest, op8_bottomk, op9_language_families, op10_jump_shards, op11_pair_ranking, op12_whitening, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {}
