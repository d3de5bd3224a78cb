"""Priority areas: six rules giving masks, their merge into levels, and area statistics.

Rules take one frame of aligned columns and return (x, y, v) with v = 1 for priority and NULL elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from .algebra import changed, emission, member, transition
from .focal import half_open_sum, ring_sum


def _mask(cells: DataFrame, condition) -> DataFrame:
    return cells.select("x", "y", F.when(F.coalesce(condition, F.lit(False)), 1).alias("v"))


def loss(cells: DataFrame, classes: Iterable[int], before: str = "before", after: str = "after") -> DataFrame:
    """Rule 1: cells of the classes that became something else."""
    return _mask(cells, changed(F.col(before), F.col(after)) & member(F.col(before), classes))


def converted(cells: DataFrame, allowed: Mapping[int, Iterable[int]], before: str = "before", after: str = "after") -> DataFrame:
    """Rule 2: cells that made one of the listed transitions."""
    return _mask(cells, changed(F.col(before), F.col(after)) & transition(F.col(before), F.col(after), allowed))


def uncovered_class(cells: DataFrame, classes: Iterable[int], value: str = "v", cover: str = "buf") -> DataFrame:
    """Rule 3: cells of the classes outside the cover."""
    return _mask(cells, F.col(cover).isNull() & member(F.col(value), classes))


def uncovered_population(cells: DataFrame, threshold: float = 1000, value: str = "v", cover: str = "buf") -> DataFrame:
    """Rule 4: cells of at least so many people outside the cover."""
    return _mask(cells, F.col(cover).isNull() & (F.col(value) >= threshold))


def uncovered(cells: DataFrame, value: str = "v", cover: str = "buf", classes: Iterable[int] = (), threshold: float = 1000) -> DataFrame:
    """Rule 3 for class maps, rule 4 for population maps, by the type of the values."""
    if cells.schema[value].dataType.simpleString() in ("float", "double"):
        return uncovered_population(cells, threshold, value, cover)
    return uncovered_class(cells, classes, value, cover)


def emission_growth(cells: DataFrame, factors: Mapping[int, float], radius: int = 3, before: str = "before", after: str = "after", compat: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """Rule 5: cells around which the emission weight grew.

    With ``compat`` a weight is class code times factor and the neighbourhood is the half-open box; without, the factor
    alone over the full box. Sums within the tolerance count as equal, since rounding decides nothing.
    """

    def weight(c):
        return emission(F.col(c), factors) * (F.coalesce(F.col(c), F.lit(0)) if compat else F.lit(1.0))

    weighed = cells.select("x", "y", before, (weight(after) - weight(before)).alias("gain"))
    if compat:
        around = half_open_sum(weighed, ["gain"], radius)
    else:
        from .focal import box_sum

        around = box_sum(weighed, ["gain"], -radius, radius)
    return _mask(around, F.col(before).isNotNull() & (F.col("box_gain") > tolerance))


def people_and_land(
    cells: DataFrame, classes: Iterable[int], radius: int = 3, land: tuple[str, str] = ("land0", "land1"), population: tuple[str, str] = ("pop0", "pop1")
) -> DataFrame:
    """Rule 6: people grow while the classes shrink around a cell, or neither does.

    The centre must be valid in all four maps. Around it, cells without class count for nothing; cells without
    population still count their class.
    """
    l0, l1, p0, p1 = (F.col(c) for c in (*land, *population))
    seen = l0.isNotNull() & l1.isNotNull()
    prepared = cells.select(
        "x",
        "y",
        (seen & p0.isNotNull() & p1.isNotNull()).alias("valid"),
        F.when(seen & member(l0, classes), 1).otherwise(0).alias("u0"),
        F.when(seen & member(l1, classes), 1).otherwise(0).alias("u1"),
        F.when(seen, F.coalesce(p1.cast("double") - p0.cast("double"), F.lit(0.0))).otherwise(0.0).alias("dp"),
    )
    around = ring_sum(prepared, ["u0", "u1", "dp"], radius)
    grows, land_grows = F.col("box_dp") > 0, F.col("box_u0") <= F.col("box_u1")
    return _mask(around, F.col("valid") & (grows != land_grows))


def merge(masks: list[DataFrame]) -> DataFrame:
    """Level of each cell: how many masks it is in (0 to their number)."""
    stacked = masks[0].select("x", "y", "v")
    for m in masks[1:]:
        stacked = stacked.unionByName(m.select("x", "y", "v"))
    return stacked.groupBy("x", "y").agg(F.count("v").cast("int").alias("level"))


def level_stats(levels: DataFrame, grid: Grid, compat: bool = True, top: int = 6) -> DataFrame:
    """Cells and km2 per level 0..top. ``compat``: level 0 is the merged map's NoData and is not counted."""
    counted = levels.filter(F.col("level").between(1 if compat else 0, top)).groupBy("level").agg(F.count("*").alias("n"))
    all_levels = levels.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("level"))
    out = all_levels.join(counted, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n_cells"))
    return out.withColumn("km2", F.col("n_cells") * F.lit(grid.cell_km2()))


def level_summary(levels: DataFrame, grid: Grid, compat: bool = True) -> DataFrame:
    """One row: total and priority cells, their share and area."""
    s = level_stats(levels, grid, compat).agg(
        F.sum("n_cells").alias("total"), F.coalesce(F.sum(F.when(F.col("level") > 0, F.col("n_cells"))), F.lit(0)).alias("priority")
    )
    return s.select("total", "priority", F.coalesce(F.try_divide(100.0 * F.col("priority"), F.col("total")), F.lit(0.0)).alias("pct"), (F.col("priority") * F.lit(grid.cell_km2())).alias("priority_km2"))
