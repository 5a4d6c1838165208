"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, dart_minhash, exact_dedup, hmm_lm, langid, media, mixing, suffix_dedup, token_cache, toxicity
from .sql import ORACLE_SQL

#: Where the public tokenizers' vocabulary files are; a deployment sets its own.
TOKENIZERS = "public_tokenizers"
#: The folder of the token counts' cache below the shared folder.
TOKEN_CACHE = "paideia-token-counts"


def tokenizer_path(name: str) -> str:
    return importlib.import_module(TOKENIZERS).path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).withColumn("held_out", F.coalesce(common.fold_of(5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.fold_of(5) != 0)
    lexicon = toxicity.learn(docs.where(~F.col("held_out")), labels)
    scored = toxicity.score(docs, lexicon, F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The cache lies in the shared folder and serves later calls: they encode only texts that no call has met.
    cache = f"{common.shared_dir(spark).rstrip('/')}/{TOKEN_CACHE}"
    return token_cache.token_counts(common.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), cache)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = F.coalesce(common.fold_of(4) == 2, F.lit(False)).alias("held_out")
    profiles = langid.learn_profiles(docs.where(F.coalesce(common.fold_of(4) != 2, F.lit(False))))
    return langid.predict(docs, profiles, held).select("doc_id", "held_out", "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir)).drop("kept")


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"))
    return media.copies_report(vectors).withColumnRenamed("image_id", "vec_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = importlib.import_module(TOKENIZERS).PATTERN
    return bpe.encoding_digests(common.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), pattern)


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(common.documents(spark, sf_dir), F.coalesce(common.fold_of(7) == 2, F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(common.documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(common.documents(spark, sf_dir), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_token_counts, op3_language_id, op4_suffix_dedup, op5_media_copies, op6_source_mixing, op7_byte_bpe, op8_hmm_scores, op9_near_dedup, op10_exact_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
