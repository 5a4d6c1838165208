"""Derived node and learner attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKABLE = ("concept", "formula", "problem_type")


def _clamped(c: Column) -> Column:
    """Null stays null: greatest and least alone would pass it over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def mastery_threshold(kind: Column, flagged: Column, given: Column | None = None) -> Column:
    """What a learner's mastery must reach: the node's own value, or one by kind."""
    rule = F.when(F.coalesce(flagged, F.lit(False)), 0.90).when(kind == "formula", 0.75).otherwise(0.80)
    return rule if given is None else F.coalesce(_clamped(given), rule)


def difficulty(kind: Column, given: Column, bloom: Column | None = None) -> Column:
    rule = F.when(kind == "formula", 0.45).when(kind == "problem_type", 0.65)
    if bloom is not None:
        level = F.lower(bloom)
        rule = rule.when(level.isin("remember", "understand"), 0.35).when(level == "apply", 0.55).when(level.isin("analyze", "evaluate", "create"), 0.75)
    return F.coalesce(_clamped(given), rule.otherwise(0.50))


def mastery_status(mastery: Column, threshold: Column) -> Column:
    return F.when(mastery >= threshold, "mastered").when(mastery <= 0.05, "unknown").when(mastery < 0.4, "fragile").otherwise("learning")


def target_band(mastery: Column) -> Column:
    return F.when(mastery < 0.4, "easy").when(mastery <= 0.7, "medium").otherwise("hard")


def or_default(value: Column, default) -> Column:
    """Missing and zero both mean the default."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")), F.lit(default))


def ability(mastery: Column) -> Column:
    """Mean mastery weighted by mastery (at least .05), an aggregate."""
    weight = F.greatest(F.lit(0.05), mastery)
    return F.coalesce(F.sum(mastery * weight) / F.sum(weight), F.lit(0.0))
