"""Quality inspection: band statistics, class inventories and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import INTEGER_TYPES, Grid, GridError, assert_aligned


def band_stats(cells: DataFrame, value: str = "v") -> DataFrame:
    """One row: n_all, n_valid, min, max, mean, nodata_pct, all_zero, all_same."""
    v = F.col(value).cast("double")
    out = cells.agg(F.count("*").alias("n_all"), F.count(v).alias("n_valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count_if(F.abs(v) >= 1e-15).alias("n_nonzero"))
    return out.select(
        "n_all",
        "n_valid",
        "min",
        "max",
        "mean",
        F.coalesce(F.try_divide(100.0 * (F.col("n_all") - F.col("n_valid")), F.col("n_all")), F.lit(0.0)).alias("nodata_pct"),
        ((F.col("n_valid") > 0) & (F.col("n_nonzero") == 0)).alias("all_zero"),
        ((F.col("n_valid") > 0) & (F.col("max") - F.col("min") < 1e-10)).alias("all_same"),
    )


def classes(cells: DataFrame, value: str = "v") -> DataFrame:
    """Distinct values and their cells."""
    return cells.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("class")).agg(F.count("*").alias("n"))


def missing_classes(cells: DataFrame, expected: list[int] | None = None, value: str = "v") -> DataFrame:
    """Expected classes (1 to the largest found where none are named) that no cell has."""
    found = classes(cells, value).select("class")
    spark = cells.sparkSession
    if expected is None:
        top = found.agg(F.max("class")).first()[0] or 0
        wanted = spark.range(1, top + 1).select(F.col("id").alias("class"))
    else:
        wanted = spark.createDataFrame([(int(c),) for c in sorted(set(expected))], "class bigint")
    return wanted.join(found, "class", "left_anti")


def inspect(cells: DataFrame, grid: Grid, reference: Grid | None = None, expected: list[int] | None = None, value: str = "v", deep: bool = True) -> DataFrame:
    """One row: the statistics with the lists of warnings and errors. ``deep=False`` looks at the grid alone."""
    spark = cells.sparkSession
    errors, warnings = [], []
    if grid.width <= 0 or grid.height <= 0:
        errors.append("invalid_dims")
    if not grid.crs:
        warnings.append("no_projection")
    if grid.bands > 1:
        warnings.append("multi_band")
    if grid.dtype not in INTEGER_TYPES:
        warnings.append("dtype_float")
    if reference is not None:
        try:
            assert_aligned(grid, reference, crs=False)
        except GridError:
            errors.append("dim_mismatch")
        if reference.crs != grid.crs:
            errors.append("proj_mismatch")
    fixed = [F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (errors, warnings)]
    if not deep:
        return spark.range(1).select(fixed[0].alias("errors"), fixed[1].alias("warnings"))
    stats = band_stats(cells, value)
    missing = missing_classes(cells, expected, value).agg(F.count("*").alias("n_missing")) if grid.dtype in INTEGER_TYPES else spark.range(1).select(F.lit(0).alias("n_missing"))
    row = stats.join(missing)  # one row each
    found = F.array_compact(
        F.array(
            F.when(F.col("n_missing") > 0, "type_missing" if expected is not None else "category_miss"),
            F.when(F.col("nodata_pct") > 30.0, "high_nodata"),
            F.when(F.col("all_zero"), "all_zero"),
            F.when(F.col("all_same"), "all_same"),
        )
    )
    none = F.when(F.col("n_valid") == 0, F.array(F.lit("no_valid_pixels"))).otherwise(F.array().cast("array<string>"))
    return row.select("*", F.concat(fixed[0], none).alias("errors"), F.concat(fixed[1], found).alias("warnings"))
