"""Token counts through a digest cache.

A table in the shared folder holds counts by (tokenizer digest, content digest) and outlives the run. A run joins the
documents' content digests to it, encodes each distinct text that it misses once, appends those counts, and joins
again. Content is normalised only as far as no count can change: null is empty.

Texts stay where they are unless they must meet: a text that is missed and occurs once in the table is encoded where
it lies; only texts that a filter of a fixed size can't part from the several times missed ones are shuffled.

Results for odd input: null and empty texts have 0 bytes and the library's count for an empty text;
rows that share a text cost one encoding; rows that share an id are counted each on its own; other columns are
ignored, whatever their names; an empty table gives an empty table and appends nothing; texts of any length are
encoded whole; counts that two runs append at once are the same count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, join_spread, maybe_among, maybe_flagged, text_of, written

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Characters that go to the library in one call.
CALL_CHARS = 1 << 20


@cache
def load_tokenizer(path: str):
    """A function from texts to counts, for tokenizers (.json) or sentencepiece (.model) files."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in s.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path}")


@cache
def tokenizer_digest(path: str) -> str:
    """Names the vocabulary and the version of its library: either may change counts."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    version = __import__(library).__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version}\n".encode() + f.read()).hexdigest()


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(path)
        for batch in batches:
            counts, call, chars = [], [], 0
            for value in batch.column(1):
                call.append(value.as_py())
                chars += len(call[-1])
                if chars >= CALL_CHARS:
                    counts += count(call)
                    call, chars = [], 0
            counts += count(call) if call else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame | None:
    """content, n_tokens for one tokenizer; None where there is no cache yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _contents(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str) -> tuple[DataFrame, int]:
    """Appends the counts of texts that the cache lacks. Returns content, rows (how many documents have it), n_tokens
    of the documents' distinct texts, and how many of these were encoded."""
    spark, name = docs.sparkSession, tokenizer_digest(tokenizer_path)
    rows = _contents(docs)
    distinct = written(rows.groupBy("content").agg(F.count(F.lit(1)).alias("rows")), "contents")
    stored = read_cache(spark, cache_path, name)
    misses = distinct if stored is None else written(distinct.join(stored, "content", "left_anti"), "misses")
    n_missed = misses.count()
    if n_missed:
        wanted = rows.select("content", "text")
        if stored is not None:
            wanted = maybe_among(wanted, "content", misses, "content")
        flagged = maybe_flagged(wanted, "content", misses.where("rows > 1"), "content")
        apart = flagged.where("NOT _may").select("content", "text")
        met = flagged.where("_may").groupBy("content").agg(F.first("text").alias("text"))
        counted = apart.unionByName(met).transform(in_arrow, _counter(tokenizer_path), "content binary, n_tokens long")
        if stored is not None:  # what the filter let pass by chance is stored already
            counted = counted.join(misses, "content", "left_semi")
        counted.withColumn("tokenizer", F.lit(name)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    filled = read_cache(spark, cache_path, name)
    if filled is None:
        return distinct.withColumn("n_tokens", F.lit(0).cast("long")), 0
    return written(distinct.join(filled, "content"), "counts"), n_missed


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit."""
    counts, _ = fill_cache(docs, tokenizer_path, cache_path)
    rows = _contents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return join_spread(rows, counts, ["content"], "rows").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
