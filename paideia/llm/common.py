"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key with more than this part of all rows is dealt to several tasks.
SHARE = 4000
#: Files of a table that operators write for themselves, for each core of the cluster.
FILES_A_CORE = 8
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8 << 20
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Only a local session may lack that setting;
    such a session gets a folder of its own, since its executors are threads of the driver.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        path = sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="paideia-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table below the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/paideia-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """The tables that operators write inside are deleted at the end: what still reads them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and a lost executor costs nothing.

    It has at most FILES_A_CORE files for each core, so that a small table of many partitions isn't thousands of tiny files:
    a task takes several partitions, one behind the other, each with the memory that it had alone. Not where cores come and go.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        df = df.coalesce(FILES_A_CORE * max(6, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow`` with batches of at most BATCH_BYTES or so, whose memory goes back when a task ends.

    The bound is the session's, as no query can set its own; a smaller one stays. A text that is longer is a batch of its own.
    """
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing

    return rows.mapInArrow(bounded, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null when the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least ``n``, within bounds."""
    size = least
    while size < n and size < most:
        size *= 2
    return size


def _filter_words(wanted: DataFrame, key: str, log_words: int) -> tuple[DataFrame, Column, Column]:
    """A Bloom filter of 2 ** ``log_words`` words of 64 bits, of that size for any number of keys: its words, and a hash's word and bit."""
    word, bit = F.col("_hash").bitwiseAND((1 << log_words) - 1), F.expr(f"shiftleft(1L, cast(shiftright(_hash, {log_words}) & 63 as int))")
    words = wanted.select(F.xxhash64(key).alias("_hash")).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return words, word, bit


def maybe_among(rows: DataFrame, column: str, wanted: DataFrame, key: str, log_words: int = 16) -> DataFrame:
    """The rows whose ``column`` may be among ``wanted``.

    The filter spares the other rows a shuffle; a full filter lets all pass. The caller still joins.
    """
    words, word, bit = _filter_words(wanted, key, log_words)
    hashed = rows.withColumn("_hash", F.xxhash64(column)).withColumn("_word", word)
    return hashed.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def maybe_flagged(rows: DataFrame, column: str, wanted: DataFrame, key: str, log_words: int = 16) -> DataFrame:
    """The rows with ``_may``: whether their ``column`` may be among ``wanted``; false is sure."""
    words, word, bit = _filter_words(wanted, key, log_words)
    hashed = rows.withColumn("_hash", F.xxhash64(column)).withColumn("_word", word)
    may = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return hashed.join(F.broadcast(words), "_word", "left").select(*rows.columns, may.alias("_may"))


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, by: str = "doc_id", how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, which has one row a key and, in ``size``, how many rows have it.

    A key with more than 1 / SHARE of all rows is dealt to as many tasks as its share asks for, by hash of the column
    ``by`` and of the task (so that a task that runs again deals alike). There are fewer than SHARE such keys, whatever
    the input, so that the list of them may be broadcast. ``groups`` is a written table, as it is read three times.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).cast("double")).first()[0] or 1.0
    parts = F.least(F.ceil(F.col(size) * (SHARE / total)), F.col(size)).cast("int")  # a row of ``groups`` is copied no oftener than rows meet it
    hot = groups.where(F.col(size) * float(SHARE) > total).select(*keys, parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(by, F.spark_partition_id()), F.col("_parts"))).otherwise(0).cast("int")
    own = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1)))
    return own.join(dealt, [*keys, "_salt"], how).drop("_salt")
