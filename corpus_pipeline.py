"""A corpus pipeline over ``documents``: filter by language, drop exact and near copies, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns rows
with the columns of ``documents``, but for the last one, which returns doc_id, n_tokens, ids_sha256 and
decoded_sha256. ``run`` writes each stage to the shared folder and reads it again; what a stage wrote for itself, and the
table before it, go when its result is written.

Odd input: null and letterless texts end at the first stage (they have no language), as do texts that are far from
all learned languages; without any labelled row all texts with a letter stay. Rows that share id and text are one
document; rows that share an id but not their text are documents of their own; rows without an id are compared like all
others. An empty table stays empty; columns besides those of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paideia.llm import bpe, common, dart_minhash, exact_dedup, langid, mixing
from paideia.llm.queries import TOKENIZERS, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the labelled languages, as their n-grams say; those without any letter go."""
    profiles = langid.learn_profiles(docs)
    return langid.keep_identified(docs, profiles)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of near duplicates, the document with the lowest id."""
    return dart_minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents, so that sources come near their targets."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    import importlib

    return bpe.encoding_digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), importlib.import_module(TOKENIZERS).PATTERN)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte BPE", encode)]
#: Language profiles and weighted signatures are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = common.scratch(spark, name.replace(" ", "_"))
        with common.scratch_scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        if before is not None:
            common.delete(spark, before.rsplit("/", 1)[0])
        docs, before = spark.read.schema(found.schema).parquet(path), path
    return docs
