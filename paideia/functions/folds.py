"""The learner's state as a fold over ordered observations (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEARN, SLIP, GUESS, PRIOR = 0.20, 0.10, 0.25, 0.10


def bkt(known: Column, correct: Column) -> Column:
    """The chance that a skill is known after one more answer."""
    hit, miss = known * (1 - SLIP), known * SLIP
    posterior = F.when(correct, hit / (hit + (1 - known) * GUESS)).otherwise(miss / (miss + (1 - known) * (1 - GUESS)))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), posterior + (1 - posterior) * LEARN))


def linear(mastery: Column, correct: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mastery + F.when(correct, 0.15).otherwise(-0.10)))


def gap(previous: Column, new: Column, correct: Column, threshold: Column) -> Column:
    return (
        F.when(new >= threshold, "mastered")
        .when(correct, F.lit(None).cast("string"))
        .when(previous < 0.4, "fundamental_gap")
        .when(previous < 0.7, "transfer_gap")
        .otherwise("trap_vulnerability")
    )


def review(state: Column, quality: Column) -> dict[str, Column]:
    """The spaced-repetition schedule after an answer of quality 0 to 5; a missing quality changes nothing."""
    q = F.greatest(F.lit(0), F.least(F.lit(5), quality))
    good, ease, reps = q >= 3, state["easiness"], state["repetitions"]
    later = F.greatest(F.lit(1), F.bround(F.greatest(state["interval_days"], F.lit(6)) * ease, 0).cast("int"))
    days = F.when(good & (reps == 1), 6).when(good & (reps > 1), later).otherwise(1)
    eased = ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    none = quality.isNull()
    return {
        "easiness": F.when(none, ease).otherwise(F.greatest(F.lit(1.3), F.least(F.lit(2.5), eased))),
        "interval_days": F.when(none, state["interval_days"]).otherwise(days).cast("int"),
        "repetitions": F.when(none, reps).when(good, reps + 1).otherwise(0).cast("int"),
        "reviewed": state["reviewed"] | ~none,
    }


#: What a review of quality 0 to 5 adds to mastery (fixed values).
QUALITY_CHANGE = (-0.30, -0.20, -0.10, 0.0, 0.05, 0.10)


def quality_change(quality: Column) -> Column:
    return F.get(F.array(*map(F.lit, QUALITY_CHANGE)), F.greatest(F.lit(0), F.least(F.lit(5), quality.cast("int"))))


STATE = {"mastery": "double", "linear": "double", "gap_type": "string", "attempts": "int", "correct_attempts": "int", "streak": "int", "easiness": "double", "interval_days": "int", "repetitions": "int", "reviewed": "boolean"}
_FIRST = {"mastery": 0.0, "linear": 0.0, "gap_type": None, "attempts": 0, "correct_attempts": 0, "streak": 0, "easiness": 2.5, "interval_days": 0, "repetitions": 0, "reviewed": False}


def _state(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[n].cast(t).alias(n) for n, t in STATE.items()])


#: How an answer moves mastery.
MODES = ("bkt", "linear")


def first_state() -> Column:
    return _state({n: F.lit(v) for n, v in _FIRST.items()})


def _step(s: Column, o: Column, threshold: Column, mode: str) -> Column:
    right = o["correct"]
    known = F.when(s["attempts"] == 0, F.greatest(s["mastery"], F.lit(PRIOR))).otherwise(s["mastery"])
    new = bkt(known, right) if mode == "bkt" else linear(s["mastery"], right)
    one = F.when(right, 1).otherwise(0)
    return _state(
        {
            "mastery": new,
            "linear": linear(s["linear"], right),
            "gap_type": gap(s["mastery"], new, right, threshold),
            "attempts": s["attempts"] + 1,
            "correct_attempts": s["correct_attempts"] + one,
            "streak": F.when(right, s["streak"] + 1).otherwise(0),
        }
        | review(s, o["quality"])
    )


def fold(observations: Column, threshold: Column) -> Column:
    """The state after ``observations``: an array, in order, of structs with correct and quality."""
    return F.aggregate(observations, first_state(), lambda s, o: _step(s, o, threshold, "bkt"))


def trail(observations: Column, threshold: Column, start: Column, mode: str = "bkt") -> Column:
    """An array of the state ``start`` and the state after each of the observations."""
    return F.aggregate(observations, F.array(start), lambda t, o: F.concat(t, F.array(_step(F.element_at(t, -1), o, threshold, mode))))
