"""Sustainability indicators: one-row frames, one partial aggregation each.

Inputs are cells with NULL for NoData. ``compat`` keeps the established definitions where those are surprising.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algebra import changed, emission, member, negative_score, neutral_score, positive_score, scaled_factors, transition


def _percent(part, whole):
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def land_proportion(cells: DataFrame, classes: Iterable[int], value: str = "v", low: float = 0, high: float = 100) -> DataFrame:
    """Share of the valid cells that belong to the classes: n_class, n_valid, pct, score."""
    v = F.col(value)
    sums = cells.agg(F.count_if(member(v, classes)).alias("n_class"), F.count(v).alias("n_valid"))
    sums = sums.withColumn("pct", _percent(F.col("n_class"), F.col("n_valid")))
    return sums.withColumn("score", F.when(F.col("n_valid") == 0, 0.0).otherwise(positive_score(F.col("pct"), low, high)))


def land_conversion(
    cells: DataFrame, allowed: Mapping[int, Iterable[int]], before: str = "before", after: str = "after", low: float = 0, high: float = 100, positive: bool = True, compat: bool = True
) -> DataFrame:
    """Listed transitions among changed cells: n_converted, n_base, pct, score.

    With ``compat`` the base is the changed cells whose class lists itself as a target; without, all cells whose
    initial class has targets.
    """
    a, b = F.col(before), F.col(after)
    valid = a.isNotNull() & b.isNotNull()
    moved = changed(a, b)
    own = [k for k, targets in allowed.items() if k in set(targets)]
    base = (moved & member(a, own)) if compat else (valid & member(a, allowed))
    out = cells.agg(F.count_if(moved & transition(a, b, allowed)).alias("n_converted"), F.count_if(base).alias("n_base"))
    out = out.withColumn("pct", _percent(F.col("n_converted"), F.col("n_base")))
    return out.withColumn("score", (positive_score if positive else negative_score)(F.col("pct"), low, high))


def coverage_class(cells: DataFrame, classes: Iterable[int], value: str = "v", cover: str = "buf", low: float = 0, high: float = 100) -> DataFrame:
    """Share of the cells of the classes that are covered (a non-NULL cover, whatever its value)."""
    of = member(F.col(value), classes)
    out = cells.agg(F.count_if(of & F.col(cover).isNotNull()).cast("double").alias("covered"), F.count_if(of).cast("double").alias("total"))
    return _coverage(out, low, high)


def coverage_population(cells: DataFrame, value: str = "v", cover: str = "buf", low: float = 0, high: float = 100) -> DataFrame:
    """Share of the population that is covered."""
    p = F.col(value).cast("double")
    out = cells.agg(F.coalesce(F.sum(F.when(F.col(cover).isNotNull(), p)), F.lit(0.0)).alias("covered"), F.coalesce(F.sum(p), F.lit(0.0)).alias("total"))
    return _coverage(out, low, high)


def _coverage(sums: DataFrame, low: float, high: float) -> DataFrame:
    pct = F.when(F.abs("total") <= 1e-15, 0.0).otherwise(F.try_divide(100.0 * F.col("covered"), F.col("total")))
    return sums.withColumn("pct", pct).withColumn("score", F.when(F.abs("total") <= 1e-15, 0.0).otherwise(positive_score(F.col("pct"), low, high)))


def growth_ratio(
    cells: DataFrame, classes: Iterable[int], land: tuple[str, str], population: tuple[str, str], low: float = 0, high: float = 100, best: float = 1.12
) -> DataFrame:
    """Growth of the classes over growth of the population, scored highest at ``best``."""
    out = cells.agg(
        *[F.count_if(member(F.col(c), classes)).cast("double").alias(f"u{k}") for k, c in enumerate(land)],
        *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"p{k}") for k, c in enumerate(population)],
    )
    u, p = F.try_divide(F.col("u1") - F.col("u0"), F.col("u0")), F.try_divide(F.col("p1") - F.col("p0"), F.col("p0"))
    dead = (F.abs("u0") < 1e-12) | (F.abs("p0") < 1e-12) | (F.abs(p) < 1e-15)
    out = out.withColumn("ratio", F.when(F.coalesce(dead, F.lit(True)), 0.0).otherwise(F.try_divide(u, p)))
    return out.withColumn("score", F.when(F.coalesce(dead, F.lit(True)), 0.0).otherwise(neutral_score(F.col("ratio"), low, best, high)))


def emission_change(cells: DataFrame, factors: Mapping[int, float], ratio: float = 0.012, before: str = "before", after: str = "after") -> DataFrame:
    """Emission after (with scaled factors) minus before: e0, e1, delta, score.

    A decrease scores 100; an increase is scored by its size, larger being higher, against the smaller emission.
    """
    out = cells.agg(
        F.coalesce(F.sum(F.when(F.col(before).isNotNull(), emission(F.col(before), factors))), F.lit(0.0)).alias("e0"),
        F.coalesce(F.sum(F.when(F.col(after).isNotNull(), emission(F.col(after), scaled_factors(factors, ratio)))), F.lit(0.0)).alias("e1"),
    )
    out = out.withColumn("delta", F.col("e1") - F.col("e0"))
    top = F.least(F.abs("e0"), F.abs("e1"))
    return out.withColumn("score", F.when(F.col("delta") <= 0, 100.0).when(top < 1e-15, 0.0).otherwise(positive_score(F.col("delta"), 0.0, top)))


def minimum_share(cells: DataFrame, classes: Iterable[int], minimum: float, value: str = "v") -> DataFrame:
    """The classes' share of the valid cells, or 0 where it stays under the minimum (the sample plug-in's rule)."""
    out = land_proportion(cells, classes, value)
    share = F.coalesce(F.try_divide(F.col("n_class").cast("double"), F.col("n_valid")), F.lit(0.0))
    return out.select(F.when(share >= minimum, share).otherwise(0.0).alias("share"))
