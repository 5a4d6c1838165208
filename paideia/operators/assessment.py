"""Assessments: a tutor's node evaluations (JSON) as evidence, and the updates of the learner's state that they cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import folds
from ..functions import labels as L
from .learner import with_attributes


def _text(body: Column, key: str) -> Column:
    return F.get_json_object(body, f"$.{key}")


def _holds(body: Column, key: str) -> Column:
    """Whether the value under ``key`` counts as true: neither null, false, zero nor empty."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{key}", "variant"))
    value = _text(body, key)
    return (
        F.when(kind == "BOOLEAN", value == "true")
        .when(kind == "STRING", value != "")
        .when(kind.startswith("ARRAY"), value != "[]")
        .when(kind.startswith("OBJECT"), value != "{}")
        .otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(False)))
    )


def is_correct(body: Column) -> Column:
    """The verdict of an evaluation: the first of correct, is_correct, score (0.6 or more) and quality (3 or more)
    that it has decides, even where that is null; without any it is false."""
    has = lambda key: F.coalesce(F.array_contains(F.json_object_keys(body), key), F.lit(False))
    number = lambda key: F.coalesce(_text(body, key).try_cast("double"), F.lit(0.0))
    return (
        F.when(has("correct"), _holds(body, "correct"))
        .when(has("is_correct"), _holds(body, "is_correct"))
        .when(has("score"), number("score") >= 0.6)
        .when(has("quality"), F.floor(number("quality")) >= 3)
        .otherwise(False)
    )


def resolved(evaluations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The evaluations (with ``ref``) with node_id, label and threshold: by id, else by label, else as they are."""
    known = with_attributes(nodes).select("id", "label", "threshold")
    named = known.groupBy(L.normalize_text(F.col("label")).alias("name")).agg(F.min("id").alias("by_name"))
    refs = evaluations.select("ref").distinct()
    found = refs.join(known.select(F.col("id").alias("ref"), F.col("id").alias("by_id")), "ref", "left").join(named, L.normalize_text(F.col("ref")) == F.col("name"), "left")
    target = found.select("ref", F.coalesce("by_id", "by_name").alias("id")).join(known, "id", "left").withColumnRenamed("id", "_id")
    rows = evaluations.join(target, "ref", "left")
    return rows.withColumn("node_id", F.coalesce("_id", "ref")).withColumn("threshold", F.coalesce("threshold", F.lit(0.8))).drop("_id")


def apply_assessments(states: DataFrame, evaluations: DataFrame, nodes: DataFrame, mode: str = "bkt") -> DataFrame:
    """A row per evaluation (learner_id, seq, at, body): the node's state before and after it.

    ``states`` are rows of ``learner.trace``. Evaluations without a node are left out. All evaluations of a
    learner's node are folded in one task, in the order of ``seq``; learners and nodes spread.
    """
    if mode not in folds.MODES:
        raise ValueError(f"mode is one of {', '.join(folds.MODES)}")
    body = F.col("body")
    ref = F.trim(F.coalesce(F.nullif(_text(body, "node_id"), F.lit("")), _text(body, "node")))
    rows = evaluations.withColumn("ref", ref).where("ref <> ''")
    rows = resolved(rows, nodes).select(
        "learner_id", "node_id", "label", "threshold", "seq", "at", is_correct(body).alias("correct"),
        _text(body, "quality").try_cast("double").cast("int").alias("quality"), _text(body, "mistake").alias("mistake"),
    )
    each = F.array_sort(F.collect_list(F.struct("seq", "at", "correct", "quality", "mistake")))
    grouped = rows.groupBy("learner_id", "node_id").agg(each.alias("e"), F.first("label", ignorenulls=True).alias("label"), F.first("threshold").alias("threshold"))
    before = F.struct(*[F.col(n) for n in folds.STATE])
    start = states.select("learner_id", "node_id", before.alias("s"))
    joined = grouped.join(start, ["learner_id", "node_id"], "left").withColumn("s", F.coalesce("s", folds.first_state()))
    # The trail has the state before the first evaluation, then one after each.
    trail = joined.withColumn("t", folds.trail(F.col("e"), F.col("threshold"), F.col("s"), mode))
    one = trail.select("learner_id", "node_id", "label", "threshold", "t", F.posexplode("e").alias("i", "o")).withColumn("was", F.get("t", F.col("i"))).withColumn("now", F.get("t", F.col("i") + 1))
    new = F.col("now.mastery")
    return one.select(
        "learner_id", F.col("o.seq").alias("seq"), "node_id", "label", F.col("was.mastery").alias("previous_mastery"), new.alias("new_mastery"), (new - F.col("was.mastery")).alias("mastery_delta"),
        (new >= F.col("threshold")).alias("is_mastered"), A.target_band(new).alias("target_difficulty"), "now.gap_type", "now.attempts", "now.correct_attempts", F.col("was.attempts").alias("previous_attempts"),
        F.col("o.at").alias("last_at"), F.when(F.col("o.quality").isNotNull(), F.col("o.at") + F.make_dt_interval(F.col("now.interval_days"))).alias("next_review_at"), F.col("o.mistake").alias("mistake"), F.col("now").alias("state"),
    )


def states_after(states: DataFrame, updates: DataFrame) -> DataFrame:
    """The states with each learner's and node's last update in place of the old row; others stay."""
    last = updates.groupBy("learner_id", "node_id").agg(F.max_by(F.struct("state", "last_at"), "seq").alias("u"), F.max_by("last_at", F.when(F.col("next_review_at").isNotNull(), F.col("seq"))).alias("new_review"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("mistake").isNotNull(), F.struct("seq", "mistake")))), lambda x: x["mistake"])).alias("new"))
    kept = [c for c in states.columns if c not in ("learner_id", "node_id")]
    both = states.withColumn("old", F.struct(*kept)).select("learner_id", "node_id", "old").join(last, ["learner_id", "node_id"], "full")
    pick = lambda n: F.when(F.col("u").isNotNull(), F.col(f"u.state.{n}")).otherwise(F.col(f"old.{n}")).alias(n)
    none = F.array().cast("array<string>")
    out = both.select(
        "learner_id", "node_id", *[pick(n) for n in folds.STATE], F.coalesce("u.last_at", "old.last_at").alias("last_at"), F.coalesce("new_review", "old.reviewed_at").alias("reviewed_at"), F.array_union(F.coalesce("old.mistakes", none), F.coalesce("new", none)).alias("mistakes")
    )
    return out.withColumn("confidence", F.least(F.lit(0.95), F.col("attempts") / 8.0))
