"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every document becomes an entry (digest, length, second hash, id), and the entries are dealt to ``fan_in`` ** r runs.
The runs then exchange entries in r rounds. A run's number has r digits; in round k, the runs that differ in digit k
only are partners, and each sends every partner the entries whose digest has the partner's digit there. What arrives
is sorted by digest and merged in one pass: neighbours that are equal in digest, length and second hash become one
entry, which keeps the identifier that stays and the number of rows. After r rounds each run holds one stretch of the
digests. A group of copies spreads over ever fewer runs while it shrinks to one entry in each, so that even a group of
a third of all rows never fills one task.

Results for odd input: null text counts as empty text; null ids lose against any other id, and a
group of null ids only keeps them all; rows that share id and text are one document, so
``dedup_report`` marks them all as kept and ``drop_copies`` returns one of them; an empty table
gives an empty table; other columns pass through ``drop_copies`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, maybe_flagged, text_of, written

#: Equal digests are accepted as equal texts only with equal length and equal second hash.
KEY = ("_digest", "_bytes", "_check")


def _key(normalise=None) -> list[Column]:
    text = text_of() if normalise is None else normalise(text_of())
    return [F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"), F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check")]


def merged_runs(docs: DataFrame, keep: str = "largest", fan_in: int = 4, rounds: int | None = None, normalise=None) -> DataFrame:
    """One row per distinct text: KEY, keep_id, group_size (rows).

    Without ``rounds``, there are as many as give at least one run for each shuffle partition of the session.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    if rounds is None:
        wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rounds = next(r for r in range(1, 64) if fan_in**r >= wanted)
    runs = fan_in**rounds
    # A struct, so that ids of any type merge alike; null for a null id, which loses.
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))
    entries = docs.select(*_key(normalise), own.alias("_id"), F.lit(1).cast("long").alias("group_size"))
    merged = entries.withColumn("_run", F.pmod(F.xxhash64("_digest", "_id", F.spark_partition_id()), F.lit(runs)).cast("int"))
    home = F.pmod(F.conv(F.hex(F.substring("_digest", 1, 7)), 16, 10).cast("long"), F.lit(runs))
    for k in reversed(range(rounds)):
        place = fan_in**k
        digit = lambda n: F.floor(n / place) % fan_in  # noqa: B023, E731
        partner = (F.col("_run") + (digit(home) - digit(F.col("_run"))) * place).cast("int")
        exchanged = merged.withColumn("_run", partner).repartitionById(runs, "_run").sortWithinPartitions("_run", *KEY)
        merged = exchanged.groupBy("_run", *KEY).agg(best("_id").alias("_id"), F.sum("group_size").alias("group_size"))
    return merged.select(*KEY, F.col("_id.doc_id").alias("keep_id"), "group_size")


def dedup_report(docs: DataFrame, keep: str = "largest", **how) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = written(merged_runs(docs, keep, **how), "groups")
    return join_spread(docs.select("doc_id", *_key()), groups, list(KEY), "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", **how) -> DataFrame:
    """The input's rows and columns without copies: one row of each group of equal texts.

    Only groups of several rows are looked up, and of the texts only those move that a filter of a fixed size can't rule out.
    """
    several = merged_runs(docs, keep, **how).where("group_size > 1")
    groups = written(several.select(*KEY, F.col("keep_id").alias("_keep"), "group_size"), "groups")
    # The rows travel as one struct, so that no column of theirs can clash.
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    keyed = maybe_flagged(docs.select(row, F.col("doc_id").alias("_id"), *_key()), "_digest", groups, "_digest")
    found = join_spread(keyed.where("_may").drop("_may"), groups, list(KEY), "group_size", "_id", "left")
    alone = found.where("group_size IS NULL").select("_row.*")  # the filter let it pass by chance
    stays = found.where("group_size > 1").where(F.col("_id").eqNullSafe(F.col("_keep")))
    # Of a group, more than one row can carry the id that stays.
    return keyed.where("NOT _may").select("_row.*").unionByName(alone).unionByName(stays.dropDuplicates(list(KEY)).select("_row.*"))
