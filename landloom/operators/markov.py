"""Markov demand: class counts, transition probabilities, and counts of later years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridError, Raster, assert_aligned


def class_counts(cells: DataFrame, period: str = "year", value: str = "v") -> DataFrame:
    """Cells per period and class; NoData and classes up to 0 do not count."""
    return cells.filter(F.col(value) > 0).groupBy(F.col(period), F.col(value).cast("bigint").alias("class")).agg(F.count("*").alias("n"))


def transition_counts(cells: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Cross-tabulation of two periods: from, to, n."""
    a, b = F.col(before), F.col(after)
    return cells.filter((a > 0) & (b > 0)).groupBy(a.cast("bigint").alias("from"), b.cast("bigint").alias("to")).agg(F.count("*").alias("n"))


def transition_probabilities(counts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Row-normalised counts: from, to, p. A class that nothing left keeps itself."""
    p = counts.select("from", "to", (F.col("n") / F.sum("n").over(Window.partitionBy("from"))).alias("p"))
    every = classes if classes is not None else counts.select(F.col("from").alias("class")).union(counts.select(F.col("to").alias("class"))).distinct()
    idle = every.join(counts.select(F.col("from").alias("class")).distinct(), "class", "left_anti")
    return p.unionByName(idle.select(F.col("class").alias("from"), F.col("class").alias("to"), F.lit(1.0).alias("p")))


def step(demand: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One multiplication: (class, n) by (from, to, p) -> (class, n), unrounded."""
    moved = demand.join(F.broadcast(probabilities), F.col("class") == F.col("from"))  # at most classes squared
    return moved.groupBy(F.col("to").alias("class")).agg(F.sum(F.col("n") * F.col("p")).alias("n"))


def predict(periods: dict[int, Raster], steps: int = 1, interval: int = 10) -> DataFrame:
    """Demand of the given years and of ``steps`` further ones: (year, class, n), rounded half away from zero.

    Probabilities come from the last two periods and are applied once per step; the unrounded counts go on.
    """
    years = sorted(periods)
    if len(years) < 2:
        raise GridError("two periods are needed")
    assert_aligned(*(r.grid for r in periods.values()))
    stacked = None
    for y in years:
        own = periods[y].cells.select("x", "y", F.lit(y).alias("year"), "v")
        stacked = own if stacked is None else stacked.unionByName(own)
    observed = class_counts(stacked)
    classes = observed.select("class").distinct()
    pair = stacked.filter(F.col("year").isin(years[-2:])).groupBy("x", "y").agg(
        F.max(F.when(F.col("year") == years[-2], F.col("v"))).alias("before"), F.max(F.when(F.col("year") == years[-1], F.col("v"))).alias("after")
    )
    # A table of at most classes squared rows; powers of it are a driver's work.
    p = {(r["from"], r["to"]): r["p"] for r in transition_probabilities(transition_counts(pair), classes).collect()}
    rows = observed.collect()
    names = sorted({r["class"] for r in rows})
    if len(names) < 2:
        raise GridError("two classes are needed")
    now = {c: 0.0 for c in names} | {r["class"]: float(r["n"]) for r in rows if r["year"] == years[-1]}
    out = [(int(r["year"]), int(r["class"]), int(r["n"])) for r in rows]
    for k in range(1, steps + 1):
        now = {b: sum(now[a] * p.get((a, b), 0.0) for a in names) for b in names}
        out += [(years[-1] + k * interval, b, int(now[b] + 0.5)) for b in names]
    return observed.sparkSession.createDataFrame(out, "year int, class bigint, n bigint")


def wide(demand: DataFrame) -> DataFrame:
    """One row per year, one column Type<k> per class."""
    names = [r[0] for r in demand.select("class").distinct().orderBy("class").collect()]
    return demand.groupBy(F.col("year").alias("Year")).agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"Type{c}") for c in names])
