"""Chart data as frames: what each chart draws, ready to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def radar(scores: DataFrame) -> DataFrame:
    """Dimensions with their mean scores, in fixed order, 0 where there is none."""
    axes = scores.sparkSession.createDataFrame([("economy", 0), ("society", 1), ("environment", 2)], "dimension string, place int")
    mean = scores.groupBy("dimension").agg(F.avg("score").alias("score"))
    return axes.join(mean, "dimension", "left").select("place", "dimension", F.coalesce("score", F.lit(0.0)).alias("score"))


def bars(scores: DataFrame, label: str = "indicator") -> DataFrame:
    """Bars in ascending order of score."""
    return scores.select(label, "score").orderBy("score", label)


def trend(scores: DataFrame) -> DataFrame:
    """Per year the composite and its dimensions in columns."""
    by = scores.groupBy("year").pivot("dimension", ["economy", "society", "environment"]).agg(F.avg("score"))
    return by.withColumn("composite", (F.coalesce("economy", F.lit(0.0)) + F.coalesce("society", F.lit(0.0)) + F.coalesce("environment", F.lit(0.0))) / 3)


def subregions(scores: DataFrame, label: str = "region", most: int = 20, top: int = 10, bottom: int = 5) -> DataFrame:
    """All regions, or the best and worst when there are more than ``most``; a row count decides, a top-k cuts."""
    if scores.limit(most + 1).count() <= most:
        return scores.select(label, "score")
    best = scores.select(label, "score").orderBy(F.col("score").desc(), label).limit(top)
    worst = scores.select(label, "score").orderBy(F.col("score"), label).limit(bottom)
    return best.unionByName(worst).distinct()


def pairs(scores: DataFrame, key: str = "region") -> DataFrame:
    """Dimension against dimension per key."""
    d = scores.groupBy(key).pivot("dimension", ["economy", "society", "environment"]).agg(F.avg("score"))
    return d.select(key, F.expr("stack(3, 'economy', economy, 'society', society, 'economy', economy, 'environment', environment, 'society', society, 'environment', environment) as (a, a_score, b, b_score)"))


def stacked_levels(levels: DataFrame) -> DataFrame:
    """(year, level, n) -> shares of the year and their running total by level."""
    year = Window.partitionBy("year")
    s = levels.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(year)), F.lit(0.0)))
    return s.withColumn("upto", F.sum("share").over(year.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))


def missing_charts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Chart references without a file."""
    return wanted.join(files.select("chart_id").distinct(), "chart_id", "left_anti")
