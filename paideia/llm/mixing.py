"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and including it, in a
shuffled order, over the source's target. The mix is the sequence of all documents, each offered
``epochs`` times, in the order of that time, cut where the word budget ends.

The running sums are made in two levels (sums of small hash ranges, then sums inside a range), so a
source with any share of the rows is spread over all tasks. For the cut, only the range of finish
times in which the budget ends is sorted; whole ranges before it are in, those after it are out.

Results for odd input: null text has size 0 and is never taken; a null source is a source of its own
and comes last; rows that share an id are separate documents, in the order of their size and then of a hash of
the row; rows without an id are shuffled by that hash; rows that are equal in every column share their copies;
other columns pass through ``mixed_documents`` untouched, whatever their names; an empty table gives an empty
table; a corpus without words has targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, power_of_two, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 4096


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), _row_hash(docs).alias("_key"))


def _row_hash(docs: DataFrame) -> Column:
    """A digest of all columns: rows of one digest are alike."""
    others = F.to_json(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]))
    return F.md5(F.concat(F.md5(text_of().cast("binary")), F.when(F.col("text").isNull(), "0").otherwise("1"), others).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """A row per source: source, source_size, target.

    Water filling: sources ordered by capacity over weight are capped one by one until the level
    that shares the rest by weight is below every remaining source's capacity.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = by_source.withColumn("_w", F.element_at(cycle, ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", (F.col("source_size") * epochs).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0.0)
    w = w.withColumns(
        {
            "_at": F.row_number().over(order),
            "_level": (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), zero))
            / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), zero)),
        }
    )
    first = F.struct("_at", "_level")
    w = w.withColumn("_free", F.min(F.when(F.col("_level") <= F.col("_ratio"), first)).over(whole))
    target = F.when(F.col("_free").isNull() | (F.col("_at") < F.col("_free._at")), F.col("_cap")).otherwise(F.col("_w") * F.col("_free._level"))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, copies.

    ``copies`` is how often the document is in the mix, ``taken`` its words there.
    """
    return planned(docs, weights, share, epochs, seed).drop("_key")


def planned(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``mix`` with ``_key``, the digest of the document's row."""
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("_key"))).cast("binary"))
    sizes = written(sized(docs), "sizes").withColumn("_h", drawn)
    total, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = power_of_two(rows / ROWS_PER_RANGE, 64, 1 << 20)
    sizes = sizes.withColumn("_range", F.floor(F.conv(F.substring("_h", 1, 5), 16, 10).cast("long") * ranges / (1 << 20)).cast("int"))
    targets = source_targets(sizes, weights, share, epochs)
    sums = sizes.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size", "_key").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        sizes.withColumn("_cum", F.sum("size").over(inside))
        .alias("q")
        .join(offsets.alias("o"), F.col("q.source").eqNullSafe(F.col("o.source")) & (F.col("q._range") == F.col("o._range")))
        .select("q.*", (F.col("_cum") + F.col("_offset")).alias("_served"))
        .alias("q")
        .join(targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source")))
        .select("q.doc_id", "q.source", "size", "_key", "_h", "_served", "source_size", "target")
    )
    queued = written(queued, "queued")

    def key(epoch: int):
        finish = F.when((F.col("target") > 0) & (F.col("size") > 0), (F.lit(epoch) * F.col("source_size") + F.col("_served")) / F.col("target"))
        return F.struct(finish.alias("finish"), F.col("_h").alias("h"), F.lit(epoch).alias("epoch"), F.col("doc_id").alias("id"), F.col("_served").alias("served"))

    offered = queued.select("size", F.explode(F.array(*[key(e) for e in range(epochs)])).alias("k")).where("k.finish IS NOT NULL")
    cut = _cut(offered, total * share, ranges)
    if cut is None:
        copies = F.lit(0)
    else:
        last = F.struct(F.lit(cut.finish).cast("double").alias("finish"), F.lit(cut.h).alias("h"), F.lit(cut.epoch).alias("epoch"), F.lit(cut.id).cast(docs.schema["doc_id"].dataType).alias("id"), F.lit(cut.served).cast("long").alias("served"))
        copies = sum((F.when(key(e).getField("finish").isNotNull() & (key(e) <= last), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), "_key")


def _cut(offered: DataFrame, budget: float, ranges: int):
    """The last entry within the budget, or None when not even the first one fits."""
    bins = offered.select("size", "k", F.floor(F.col("k.finish") * ranges).cast("long").alias("_bin"))
    sums = bins.groupBy("_bin").agg(F.sum("size").alias("_sum"), F.max("k").alias("_last"))
    upto = sums.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_bin")))
    whole = upto.where(F.col("_upto") <= budget).orderBy(F.col("_bin").desc()).select("_last", "_upto").first()
    over = upto.where(F.col("_upto") > budget).orderBy("_bin").select("_bin", "_sum", "_upto").first()
    if over is not None:
        running = F.sum("size").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over["_upto"] - over["_sum"])
        part = bins.where(F.col("_bin") == over["_bin"]).select("k", running.alias("_run")).where(F.col("_run") <= budget).agg(F.max("k").alias("k")).first()
        if part["k"] is not None:
            return part["k"]
    return None if whole is None else whole["_last"]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's columns, each document as often as the mix takes it."""
    # A row's digest is its name: rows that are equal in all columns are one row that the mix takes as often as all of them.
    plan = planned(docs, **options).groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0")
    plan = written(plan, "plan")
    # The rows travel as one struct, so that no column of theirs can clash.
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _row_hash(docs).alias("_key"))
    found = join_spread(keyed, plan, ["_key"], "_rows", "_key")
    several = found.where("_rows > 1").dropDuplicates(["_key"])
    taken = found.where("_rows = 1").unionByName(several)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
