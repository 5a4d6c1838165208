"""Learner operators: mastery tracing, ability, readiness, mirror view, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import attributes as A
from ..functions import folds


#: Columns that a node may have of its own.
GIVEN = {"difficulty_given": "double", "threshold_given": "double", "is_threshold": "boolean", "minutes": "int", "exam_relevance": "double"}


def with_attributes(nodes: DataFrame) -> DataFrame:
    """Nodes with threshold, difficulty, minutes and exam relevance: their own (threshold_given, difficulty_given, bloom_level ...) or by the default rules."""
    bloom = F.col("bloom_level") if "bloom_level" in nodes.columns else F.try_element_at("properties", F.lit("bloom_level")) if "properties" in nodes.columns else None
    nodes = nodes.withColumns({c: F.lit(None).cast(t) for c, t in GIVEN.items() if c not in nodes.columns})
    return nodes.withColumns(
        {
            "threshold": A.mastery_threshold(F.col("kind"), F.col("is_threshold"), F.col("threshold_given")),
            "difficulty": A.difficulty(F.col("kind"), F.col("difficulty_given"), bloom),
            "minutes": A.or_default(F.col("minutes").cast("double"), 15.0).cast("int"),
            "exam_relevance": A.or_default(F.col("exam_relevance"), 0.5),
        }
    )


def trace(observations: DataFrame, threshold: Column | None = None) -> DataFrame:
    """A row for each learner and node: the state after all observations in the order of (ts, event_id).

    One pair's history is folded in one task, as each state rests on the one before; pairs spread.
    """
    history = F.array_sort(F.collect_list(F.struct("ts", "event_id", "correct", "quality", "mistake")))
    grouped = observations.groupBy("learner_id", "node_id").agg(history.alias("h"))
    state = folds.fold(F.col("h"), F.lit(0.8) if threshold is None else threshold)
    done = grouped.select("learner_id", "node_id", state.alias("s"), F.element_at("h", -1)["ts"].alias("last_at"), F.try_element_at(F.filter("h", lambda o: o["quality"].isNotNull()), F.lit(-1))["ts"].alias("reviewed_at"), F.array_distinct(F.filter("h.mistake", lambda m: m.isNotNull())).alias("mistakes"))
    return done.select("learner_id", "node_id", "s.*", "last_at", "reviewed_at", "mistakes").withColumn("confidence", F.least(F.lit(0.95), F.col("attempts") / 8.0))


def abilities(states: DataFrame) -> DataFrame:
    return states.groupBy("learner_id").agg(A.ability(F.col("mastery")).alias("ability"), F.count(F.lit(1)).alias("n_states"))


def overlay(nodes: DataFrame, states: DataFrame, learner_id: int) -> DataFrame:
    """All trackable nodes with one learner's state; what the learner never met has mastery 0."""
    own = states.where(F.col("learner_id") == learner_id).select(F.col("node_id").alias("id"), "mastery", "gap_type", "attempts")
    joined = with_attributes(nodes).where(F.col("kind").isin(*A.TRACKABLE)).join(own, "id", "left")
    return joined.withColumn("mastery", F.coalesce("mastery", F.lit(0.0))).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def unmet(view: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_unmet, unmet (labels, sorted): direct prerequisites below their threshold."""
    needs = edges.where("relation = 'REQUIRES'").select(F.col("source_id").alias("id"), F.col("target_id"))
    low = view.where(F.col("mastery") < F.col("threshold")).select(F.col("id").alias("target_id"), F.col("label").alias("need"))
    return needs.join(low, "target_id").groupBy("id").agg(F.count(F.lit(1)).alias("n_unmet"), F.array_join(F.sort_array(F.collect_list("need")), "|").alias("unmet"))


def mirror(nodes: DataFrame, edges: DataFrame, states: DataFrame, learner_id: int) -> DataFrame:
    view = overlay(nodes, states, learner_id)
    return view.join(unmet(view, edges), "id", "left").select(
        "id", "label", "kind", "mastery", A.mastery_status(F.col("mastery"), F.col("threshold")).alias("status"), "gap_type", F.coalesce("unmet", F.lit("")).alias("blocked_by"), "difficulty", "threshold"
    )


def readiness(nodes: DataFrame, edges: DataFrame, states: DataFrame, learner_id: int, tolerance: float = 0.30) -> DataFrame:
    """Unmastered nodes by bucket (blocked, zpd; ready marks the zpd nodes near the learner's ability) with score."""
    view = overlay(nodes, states, learner_id)
    own = states.where(F.col("learner_id") == learner_id).agg(A.ability(F.col("mastery")).alias("a"), F.count(F.lit(1)).alias("n"))
    level = own.select(F.when(F.col("n") > 0, F.col("a")).otherwise(0.30).alias("ability"))  # one row
    open_ = view.where(F.col("mastery") < F.col("threshold")).join(unmet(view, edges), "id", "left").join(F.broadcast(level))
    closeness = 1 - F.least(F.lit(1.0), F.abs(F.col("difficulty") - F.col("ability")))
    score = (
        (F.col("threshold") - F.col("mastery")) * 0.45
        + closeness * 0.25
        + F.col("exam_relevance") * 0.20
        + F.when(F.col("is_threshold"), 0.15).otherwise(0.0)
        + F.when(F.col("gap_type").isin("fundamental_gap", "transfer_gap"), 0.10).otherwise(0.0)
    )
    blocked = F.col("n_unmet").isNotNull()
    return open_.select(
        "id", "label", "kind", "mastery", "threshold", "difficulty", F.coalesce("n_unmet", F.lit(0)).alias("n_unmet"), F.coalesce("unmet", F.lit("")).alias("unmet"),
        F.when(blocked, "blocked").otherwise("zpd").alias("bucket"),
        (~blocked & (F.col("difficulty") - F.col("ability") <= tolerance)).alias("ready"),
        F.when(blocked, -1.0).otherwise(score).alias("score"),
    )


def best_first(candidates: DataFrame) -> list[Column]:
    return [F.round("score", 9).desc(), F.col("difficulty"), F.col("label"), F.col("id")]


def next_node(candidates: DataFrame) -> DataFrame:
    """The best ready node, or else the best one of the zone."""
    return candidates.where("bucket = 'zpd'").orderBy(F.col("ready").desc(), *best_first(candidates)).limit(1)


def due(states: DataFrame, as_of: Column) -> DataFrame:
    """Due states with priority: overdue days weighted by what is not mastered. A review is due so many days after the last one."""
    at = F.col("reviewed_at") + F.make_dt_interval(F.col("interval_days"))
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("next_review_at").cast("timestamp"))) / 86400e6
    priority = F.when(F.col("next_review_at").isNull(), F.when(F.col("attempts") > 0, 1.0).otherwise(0.0)).otherwise(days * (1 - F.col("mastery") * 0.3) * 10)
    is_due = F.when(F.col("next_review_at").isNull(), F.col("attempts") > 0).otherwise(days >= 0)
    return states.withColumn("next_review_at", at).withColumn("due", is_due).withColumn("priority", priority)


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def accuracy(attempts: Column, correct: Column) -> Column:
    """The share of right answers; 0 without any."""
    return F.coalesce(F.try_divide(correct, attempts), F.lit(0.0))


def totals(view: DataFrame) -> DataFrame:
    """One row: mastered_count and total_trackable of a learner's view."""
    return view.agg(F.count_if(F.col("mastery") >= F.col("threshold")).alias("mastered_count"), F.count(F.lit(1)).alias("total_trackable"))


def trackable(nodes: DataFrame) -> DataFrame:
    """The nodes that a learner can master, easy ones first."""
    return with_attributes(nodes).where(F.col("kind").isin(*A.TRACKABLE)).orderBy("difficulty", "label", "id")


def due_list(nodes: DataFrame, states: DataFrame, learner_id: int, as_of: Column, limit: int = 10) -> DataFrame:
    """id, label, mastery, priority of a learner's due nodes, most urgent first."""
    rows = due(states.where(F.col("learner_id") == learner_id), as_of).where("due")
    known = nodes.where(F.col("kind").isin(*A.TRACKABLE)).select(F.col("id").alias("node_id"), "label")
    found = rows.join(known, "node_id").select(F.col("node_id").alias("id"), "label", "mastery", "priority")
    return found.orderBy(F.desc("priority"), "id").limit(limit)


def ranked(candidates: DataFrame, n: int, by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """The ``n`` best candidates of each bucket (or learner and bucket), with ``rank``: blocked ones by how few prerequisites they lack."""
    order = [F.when(F.col("bucket") == "blocked", F.col("n_unmet")).otherwise(0), *best_first(candidates)]
    return top(candidates, list(by), order, n)


def candidate_packets(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates as tutors read them: with relevance, reason, and their open prerequisites under both names."""
    relevance = with_attributes(nodes).select("id", "exam_relevance")
    open_ = F.when(F.col("unmet") == "", F.array().cast("array<string>")).otherwise(F.split("unmet", r"\|"))
    reason = F.when(F.col("bucket") == "blocked", "blocked_by_prerequisites").otherwise("prerequisites_met")
    own = ["bucket", "ready", "score", "kind", "label", "mastery", "threshold", "difficulty"]
    extra = ["rank"] if "rank" in candidates.columns else []
    return candidates.join(relevance, "id", "left").select(F.col("id").alias("node_id"), *own, *extra, F.coalesce("exam_relevance", F.lit(0.5)).alias("exam_relevance"), reason.alias("reason"), open_.alias("unmet_prerequisites"), open_.alias("blocking_prerequisites"))


def recent_mistakes(states: DataFrame, learner_id: int, limit: int = 8) -> DataFrame:
    """place, mistake: a learner's distinct mistakes, those of the node met last first, ``limit`` of them."""
    own = states.where(F.col("learner_id") == learner_id).select("last_at", "node_id", F.posexplode("mistakes").alias("pos", "mistake")).where("mistake <> ''")
    order = F.struct((-F.unix_micros(F.col("last_at").cast("timestamp"))).alias("late"), "node_id", "pos")
    first = own.groupBy("mistake").agg(F.min(order).alias("o")).orderBy("o", "mistake").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("o", "mistake")).alias("place"), "mistake")
