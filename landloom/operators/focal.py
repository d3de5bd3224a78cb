"""Neighbourhoods by separable window passes over a dense grid.

A box sum is two one-dimensional range windows, so its cost does not grow with the radius. The grid must be dense: give
every cell a row and NoData weight 0. Pack all columns of one neighbourhood into one call: each call costs two shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_sum(df: DataFrame, columns: list[str], low: int, high: int) -> DataFrame:
    """Adds ``box_<c>``: the sum of c over [x + low, x + high] x [y + low, y + high]."""
    if low > high:
        return df.select("*", *[F.lit(0).cast(df.schema[c].dataType).alias(f"box_{c}") for c in columns])
    along = Window.partitionBy("y").orderBy("x").rangeBetween(low, high)
    across = Window.partitionBy("x").orderBy("y").rangeBetween(low, high)
    out = df.select("*", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"_{c}") for c in columns])
    out = out.select("*", *[F.coalesce(F.sum(f"_{c}").over(across), F.lit(0)).alias(f"box_{c}") for c in columns])
    return out.drop(*[f"_{c}" for c in columns])


def ring_sum(df: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Adds ``box_<c>`` over the (2 r + 1)-square without its centre."""
    out = box_sum(df, columns, -radius, radius)
    return out.select(*df.columns, *[(F.col(f"box_{c}") - F.col(c)).alias(f"box_{c}") for c in columns])


def half_open_sum(df: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Adds ``box_<c>`` over x - r < x' <= x + r and likewise y, leaving out the first row and column of the grid.

    These are the sums that differences of a summed-area table give when its zero row and column are cells themselves.
    """
    inner = df.select("*", *[F.when((F.col("x") > 0) & (F.col("y") > 0), F.col(c)).otherwise(F.lit(0)).alias(f"in_{c}") for c in columns])
    out = box_sum(inner, [f"in_{c}" for c in columns], -(radius - 1), radius)
    return out.select(*df.columns, *[F.col(f"box_in_{c}").alias(f"box_{c}") for c in columns])


def class_share(df: DataFrame, value: str, classes: list[int], size: int, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds ``share_<k>``: cells of class k around a cell, over its neighbours in the grid, times k's weight (1 / K)."""
    half = size // 2
    ones = df.select("*", *[F.coalesce((F.col(value) == k).cast("int"), F.lit(0)).alias(f"is_{k}") for k in classes], F.lit(1).alias("cell"))
    around = ring_sum(ones, [*[f"is_{k}" for k in classes], "cell"], half)
    w = weights or {k: 1 / len(classes) for k in classes}
    return around.select(*df.columns, *[F.coalesce(F.try_divide(F.col(f"box_is_{k}") * F.lit(float(w[k])), F.col("box_cell")), F.lit(0.0)).alias(f"share_{k}") for k in classes])
