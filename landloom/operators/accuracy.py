"""Accuracy of simulated change, agreement of maps, and statistics of sample pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def change_accuracy(cells: DataFrame, original: str = "original", simulated: str = "simulated", real: str = "real") -> DataFrame:
    """Misses (a), hits (b), wrong classes (c), false alarms (d), with fom, pa and ua."""
    o, s, r = F.col(original), F.col(simulated), F.col(real)
    out = cells.filter(o.isNotNull() & s.isNotNull() & r.isNotNull()).agg(
        F.count_if((r != o) & (s == o)).alias("a"),
        F.count_if((r != o) & (s == r)).alias("b"),
        F.count_if((r != o) & (s != o) & (s != r)).alias("c"),
        F.count_if((r == o) & (s != o)).alias("d"),
    )
    a, b, c, d = (F.col(k) for k in "abcd")
    return out.select("*", _ratio(b, a + b + c + d).alias("fom"), _ratio(b, a + b + c).alias("pa"), _ratio(b, b + c + d).alias("ua"))


def map_agreement(cells: DataFrame, original: str = "original", simulated: str = "simulated", real: str = "real") -> DataFrame:
    """Overall agreement and kappa; expected agreement counts the classes that the real map has."""
    o, s, r = F.col(original), F.col(simulated), F.col(real)
    valid = cells.filter(o.isNotNull() & s.isNotNull() & r.isNotNull())
    # One pass: a cross-tabulation is as small as the classes squared.
    table = valid.groupBy(s.alias("s"), r.alias("r")).agg(F.count("*").alias("n"))
    by_s, by_r = table.groupBy("s").agg(F.sum("n").alias("ns")), table.groupBy("r").agg(F.sum("n").alias("nr"))
    marginal = by_r.join(by_s, F.col("r") == F.col("s"), "left").agg(F.sum(F.coalesce("ns", F.lit(0))).alias("n"), F.sum(F.coalesce("ns", F.lit(0)).cast("double") * F.col("nr")).alias("cross"))
    right = table.agg(F.coalesce(F.sum(F.when(F.col("s") == F.col("r"), F.col("n"))), F.lit(0)).alias("right"), F.sum("n").alias("all"))
    out = right.join(marginal)  # one row each
    pe = F.try_divide(F.col("cross"), F.col("n").cast("double") * F.col("n"))
    out = out.select(F.try_divide(F.col("right").cast("double"), F.col("all")).alias("po"), pe.alias("pe"), F.coalesce(F.try_divide(F.col("right").cast("double"), F.col("n")), F.lit(0.0)).alias("oa"))
    return out.select("po", "pe", "oa", F.when(F.abs(1 - F.col("pe")) <= 1e-12, 0.0).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))).alias("kappa"))


def step_accuracy(cells: DataFrame, original: str = "original", simulated: str = "simulated", real: str = "real") -> DataFrame:
    """The simulator's own metrics: a hits, b misses, c wrong class or false alarm, d rightly unchanged."""
    o, s, r = F.col(original), F.col(simulated), F.col(real)
    out = cells.filter(r.isNotNull() & (r > 0) & o.isNotNull() & s.isNotNull()).agg(
        F.count_if((r != o) & (s == r)).alias("a"),
        F.count_if((r != o) & (s == o)).alias("b"),
        F.count_if((s != o) & (s != r)).alias("c"),
        F.count_if((r == o) & (s == o)).alias("d"),
    )
    a, b, c = (F.col(k) for k in "abc")
    return out.select("*", _ratio(a, a + b + c).alias("fom"), _ratio(a, a + b).alias("pa"), _ratio(a, a + c).alias("ua"))


def binary_change_accuracy(cells: DataFrame, original: str, predicted: str, real: str) -> DataFrame:
    """Change against no change, whatever the class: a both, b missed, c false, d neither; oa and kappa."""
    o, p, r = F.col(original), F.col(predicted), F.col(real)
    out = cells.filter(o.isNotNull() & p.isNotNull() & r.isNotNull()).agg(
        F.count_if((r != o) & (p != o)).alias("a"), F.count_if((r != o) & (p == o)).alias("b"), F.count_if((r == o) & (p != o)).alias("c"), F.count_if((r == o) & (p == o)).alias("d")
    )
    return _two_by_two(out)


def binary_accuracy(cells: DataFrame, predicted: str = "predicted", real: str = "real") -> DataFrame:
    """Occupied against free: a true positive, b false negative, c false positive, d true negative; oa, pa, ua, kappa, fom."""
    p, r = F.coalesce(F.col(predicted), F.lit(0)) == 1, F.coalesce(F.col(real), F.lit(0)) == 1
    out = cells.agg(F.count_if(p & r).alias("a"), F.count_if(~p & r).alias("b"), F.count_if(p & ~r).alias("c"), F.count_if(~p & ~r).alias("d"))
    a, b, c = (F.col(k) for k in "abc")
    return _two_by_two(out).select("*", _ratio(a, a + b).alias("pa"), _ratio(a, a + c).alias("ua"), (a / (a + c + F.lit(0.1))).alias("fom"))


def _two_by_two(out: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    n = a + b + c + d
    po = F.coalesce(F.try_divide(a + d, n), F.lit(0.0))
    pe = F.coalesce(F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n * n), F.lit(0.0))
    return out.select("*", po.alias("oa"), F.when(F.abs(1 - pe) <= 1e-12, 0.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def pearson(samples: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Correlation; 0 for fewer than two samples or a constant series, clamped to [-1, 1]."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = samples.filter(x.isNotNull() & y.isNotNull()).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]
    )
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt(F.greatest((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")), F.lit(0.0)))
    return s.select(F.when((F.col("n") < 2) | (low < 1e-15), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(top, low)))).alias("r"))


def welch_t(samples: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Two-sample t statistic with unequal variances; 0 for fewer than two samples or no spread."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = samples.agg(*[f(e).alias(f"{k}{i}") for i, e in ((1, x), (2, y)) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    spread = F.sqrt(F.col("v1") / F.nullif(F.col("n1"), F.lit(0)) + F.col("v2") / F.nullif(F.col("n2"), F.lit(0)))
    dead = (F.col("n1") < 2) | (F.col("n2") < 2) | (spread < 1e-15)
    return s.select(F.when(F.coalesce(dead, F.lit(True)), 0.0).otherwise(F.try_divide(F.col("m1") - F.col("m2"), spread)).alias("t"))
