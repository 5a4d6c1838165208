"""Mastery as a stream: the batch fold, continued as observations arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.folds import GUESS, LEARN, PRIOR, SLIP

STATE = "mastery double, linear double, gap_type string, attempts int, correct_attempts int, streak int, easiness double, interval_days int, repetitions int, reviewed boolean, last_at timestamp, reviewed_at timestamp"
_NAMES = [f.split()[0] for f in STATE.split(", ")]
_FIRST = dict(zip(_NAMES, (0.0, 0.0, None, 0, 0, 0, 2.5, 0, 0, False, None, None)))


def updated(known: float, correct: bool) -> float:
    hit, miss = known * (1 - SLIP), known * SLIP
    posterior = hit / (hit + (1 - known) * GUESS) if correct else miss / (miss + (1 - known) * (1 - GUESS))
    return max(0.01, min(0.99, posterior + (1 - posterior) * LEARN))


def stepped(state: dict, correct: bool, quality: int | None, at, threshold: float = 0.8) -> dict:
    """The state after one more observation, as the batch fold has it."""
    was = state["mastery"]
    new = updated(max(was, PRIOR) if not state["attempts"] else was, correct)
    if new >= threshold:
        gap = "mastered"
    elif correct:
        gap = None
    else:
        gap = "fundamental_gap" if was < 0.4 else "transfer_gap" if was < 0.7 else "trap_vulnerability"
    out = state | {
        "mastery": new, "linear": max(0.0, min(1.0, state["linear"] + (0.15 if correct else -0.10))), "gap_type": gap, "attempts": state["attempts"] + 1,
        "correct_attempts": state["correct_attempts"] + bool(correct), "streak": state["streak"] + 1 if correct else 0, "last_at": at,
    }
    if quality is None:
        return out
    q, ease, reps = max(0, min(5, quality)), state["easiness"], state["repetitions"]
    days = 1 if q < 3 or not reps else 6 if reps == 1 else max(1, round(max(state["interval_days"], 6) * ease))
    ease = max(1.3, min(2.5, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))))
    return out | {"easiness": ease, "interval_days": days, "repetitions": reps + 1 if q >= 3 else 0, "reviewed": True, "reviewed_at": at}


def mastery_stream(observations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """learner_id, node_id and the whole state after each micro-batch, for a stream of observations.

    Evidence counts in the order of (ts, event_id) within a micro-batch, and micro-batches in the order of arrival.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        own = dict(zip(_NAMES, state.get)) if state.exists else dict(_FIRST)
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            quality = None if pd.isna(row.quality) else int(row.quality)
            own = stepped(own, bool(row.correct), quality, row.ts, threshold)
        state.update(tuple(own[n] for n in _NAMES))
        yield pd.DataFrame({"learner_id": [key[0]], "node_id": [key[1]], **{n: [own[n]] for n in _NAMES}})

    rows = observations.select("learner_id", "node_id", "correct", observations["ts"].cast("timestamp").alias("ts"), "event_id", observations["quality"].cast("double").alias("quality"))
    return rows.groupBy("learner_id", "node_id").applyInPandasWithState(step, f"learner_id long, node_id string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def traced(observations: DataFrame, folder: str) -> DataFrame:
    """The last state of each learner and node of a stream that is read to its end: what has arrived by now.

    Micro-batches are written below ``folder``, which all executors share, with the stream's own checkpoint.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")  # a batch that runs again replaces itself

    stream = mastery_stream(observations).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = observations.sparkSession.read.schema(f"learner_id long, node_id string, {STATE}").parquet(f"{folder}/states")
    return rows.groupBy("learner_id", "node_id").agg(F.max_by(F.struct(*_NAMES), "attempts").alias("s")).select("learner_id", "node_id", "s.*")
