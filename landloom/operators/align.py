"""Positional joins of rasters, and re-gridding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, GridError, Raster, assert_aligned


def align(rasters: dict[str, Raster], check_crs: bool = True) -> DataFrame:
    """(x, y, one column per raster) with one shuffle for any number of rasters.

    The rasters are stacked and grouped by cell instead of joined one after another. Cells that no raster has a row for
    are absent; a cell that a raster lacks is NULL in its column.
    """
    assert_aligned(*(r.grid for r in rasters.values()), crs=check_crs)
    names = list(rasters)
    stacked = None
    for name in names:
        own = rasters[name].cells.select("x", "y", *[(F.col("v") if n == name else F.lit(None).cast(rasters[n].cells.schema["v"].dataType)).alias(n) for n in names])
        stacked = own if stacked is None else stacked.unionByName(own)
    return stacked.groupBy("x", "y").agg(*[F.max(n).alias(n) for n in names])


def mask_by(mask: Raster, raster: Raster, fill: float | None = None) -> DataFrame:
    """``raster`` where ``mask`` is valid, else ``fill`` (NULL by default)."""
    both = align({"mask": mask, "v": raster})
    return both.select("x", "y", F.when(F.col("mask").isNull(), F.lit(fill)).otherwise(F.col("v")).alias("v"))


def _mercator(x: Column, y: Column, inverse: bool) -> tuple[Column, Column]:
    r = 6378137.0
    if inverse:
        return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
    return F.radians(x) * r, F.log(F.tan(math.pi / 4 + F.radians(y) / 2)) * r


def resample(source: Raster, base: Grid, method: str = "nearest") -> DataFrame:
    """Cells (x, y, v) of ``source`` on the cells of ``base``.

    Nearest is one equi-join on the source cell under each base cell's centre. Bilinear explodes the four source cells
    around the centre with their weights into one equi-join and one aggregation; weights of absent cells are shared out
    among the others. The same projection is needed, or longitude/latitude against web Mercator.
    """
    if not base.crs:
        raise GridError("the base grid has no projection")
    if method not in ("nearest", "bilinear"):
        raise GridError(f"unknown method {method}")
    if source.grid == base or (source.grid.transform == base.transform and source.grid.crs == base.crs and (source.grid.width, source.grid.height) == (base.width, base.height)):
        return source.cells.select("x", "y", "v")
    spark = source.cells.sparkSession
    t, s = base.transform, source.grid.transform
    n = F.col("id")
    # Integer division, not floor of a quotient: cell numbers pass 2^53 long after doubles do.
    cells = spark.range(base.width * base.height).select((n % base.width).cast("int").alias("x"), F.expr(f"id div {base.width}").cast("int").alias("y"))
    cx = F.lit(t[0]) + (F.col("x") + 0.5) * t[1] + (F.col("y") + 0.5) * t[2]
    cy = F.lit(t[3]) + (F.col("x") + 0.5) * t[4] + (F.col("y") + 0.5) * t[5]
    if base.crs != source.grid.crs:
        pair = {_epsg(base.crs), _epsg(source.grid.crs)}
        if pair != {"4326", "3857"}:
            raise GridError(f"cannot transform {base.crs} to {source.grid.crs}")
        cx, cy = _mercator(cx, cy, inverse=_epsg(base.crs) == "3857")
    det = s[1] * s[5] - s[2] * s[4]
    col = ((cx - s[0]) * s[5] - (cy - s[3]) * s[2]) / det
    row = ((cy - s[3]) * s[1] - (cx - s[0]) * s[4]) / det
    placed = cells.withColumn("c", col).withColumn("r", row)
    v = source.cells.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    if method == "nearest":
        hit = placed.withColumn("sx", F.floor("c").cast("int")).withColumn("sy", F.floor("r").cast("int"))
        return hit.join(v, ["sx", "sy"], "left").select("x", "y", "v")
    fx, fy = F.col("c") - 0.5, F.col("r") - 0.5
    corners = F.array(
        *[
            F.struct(
                (F.floor(fx) + dx).cast("int").alias("sx"),
                (F.floor(fy) + dy).cast("int").alias("sy"),
                ((fx - F.floor(fx) if dx else 1 - fx + F.floor(fx)) * (fy - F.floor(fy) if dy else 1 - fy + F.floor(fy))).alias("w"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    four = placed.select("x", "y", F.explode(corners).alias("k")).select("x", "y", "k.*")
    near = four.join(v, ["sx", "sy"], "left")
    have = F.col("v").isNotNull()
    total = near.groupBy("x", "y").agg(F.sum(F.when(have, F.col("w") * F.col("v"))).alias("a"), F.sum(F.when(have, F.col("w"))).alias("b"))
    return total.select("x", "y", F.try_divide("a", "b").alias("v"))


def _epsg(crs: str) -> str:
    import re

    found = re.findall(r"(\d{4,5})", crs)
    return found[-1] if found else crs


def overview(cells: DataFrame, factor: int) -> DataFrame:
    """A coarser level: the value of the upper left valid cell of each factor x factor block."""
    key = [F.expr(f"{c} div {int(factor)}").cast("int").alias(c) for c in ("x", "y")]
    first = F.min(F.when(F.col("v").isNotNull(), F.struct("y", "x", "v")))
    return cells.groupBy(*key).agg(first.alias("f")).select("x", "y", F.col("f.v").alias("v"))
