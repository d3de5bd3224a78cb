"""Column builders: class predicates, transitions, emission factors and score normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(value: Column, classes: Iterable[int]) -> Column:
    """Class membership; NULL (NoData) and an empty set are not members."""
    classes = sorted(set(classes))
    return F.coalesce(value.isin(classes), F.lit(False)) if classes else F.lit(False)


def changed(before: Column, after: Column) -> Column:
    """Both valid and different."""
    return F.coalesce(before != after, F.lit(False))


def transition(before: Column, after: Column, allowed: Mapping[int, Iterable[int]]) -> Column:
    """``after`` is a listed target of ``before``."""
    out = F.lit(False)
    for source, targets in sorted(allowed.items()):
        out = out | ((before == source) & member(after, targets))
    return F.coalesce(out, F.lit(False))


def emission(value: Column, factors: Mapping[int, float]) -> Column:
    """Factor of a class; classes without one (and NoData) weigh nothing."""
    if not factors:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in sorted(factors.items()) for x in (int(k), float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value.cast("int")), F.lit(0.0))


def scaled_factors(factors: Mapping[int, float], ratio: float) -> dict[int, float]:
    """Emitters shrink by the ratio, sinks grow by it."""
    return {k: v * (1 - ratio) if v > 0 else v * (1 + ratio) if v < 0 else 0.0 for k, v in factors.items()}


def positive_score(value: Column, low: float | Column, high: float | Column) -> Column:
    """Linear from 0 at ``low`` to 100 at ``high``; a degenerate range is a step at ``high``."""
    low, high = _column(low), _column(high)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(value - low, high - low) * 100.0))
    return F.when(F.abs(high - low) < 1e-15, F.when(value >= high, 100.0).otherwise(0.0)).otherwise(inside)


def negative_score(value: Column, low: float | Column, high: float | Column) -> Column:
    """Linear from 100 at ``low`` to 0 at ``high``."""
    low, high = _column(low), _column(high)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(high - value, high - low) * 100.0))
    return F.when(F.abs(high - low) < 1e-15, F.when(value <= low, 100.0).otherwise(0.0)).otherwise(inside)


def neutral_score(value: Column, low: float, best: float, high: float) -> Column:
    """100 at ``best``, falling to 0 at both ends; 0 outside them and where the best is an end."""
    if best <= low or best >= high:
        return F.lit(0.0)
    rising = (value - low) / (best - low) * 100.0
    falling = (high - value) / (high - best) * 100.0
    return F.when((value < low) | (value > high), 0.0).when(value <= best, rising).otherwise(falling)


def score_label(score: Column) -> Column:
    """Bands at 80, 60 and 40."""
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
