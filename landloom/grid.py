"""Rasters as relations: one row per cell keyed by (x, y), NoData as NULL, metadata beside the rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: Stored type name -> Spark type that holds all its values (Spark has no unsigned types).
WIDENED = {"Byte": "smallint", "Int16": "smallint", "UInt16": "int", "Int32": "int", "UInt32": "bigint", "Float32": "float", "Float64": "double"}
INTEGER_TYPES = frozenset({"Byte", "Int16", "UInt16", "Int32", "UInt32"})
#: Width of the unsigned and signed stored types, for wrapping at the sink.
_WRAP = {"Byte": (256, 0), "UInt16": (65536, 0), "UInt32": (1 << 32, 0), "Int16": (65536, 32768), "Int32": (1 << 32, 1 << 31)}


class GridError(ValueError):
    """Inputs do not fit together or are not usable rasters."""


@dataclass(frozen=True)
class Grid:
    """Size, place and storage of a raster; one small object on the driver, never repeated per row."""

    width: int
    height: int
    transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str = ""
    nodata: float | None = None
    dtype: str = "Byte"
    bands: int = 1

    @property
    def geographic(self) -> bool:
        return "4326" in self.crs or self.crs.startswith("GEOGCS")

    def fixed(self) -> Grid:
        """Without a projection the origin is put so that rows count upwards from zero."""
        if self.crs:
            return self
        t = list(self.transform)
        t[3] = -(self.height * t[5])
        return replace(self, transform=tuple(t))

    def cell_km2(self) -> float:
        """Area of a cell: degrees scaled at the grid's middle latitude, else metres."""
        import math

        w, h = abs(self.transform[1]), abs(self.transform[5])
        if self.geographic:
            middle = self.transform[3] + self.transform[5] * self.height / 2
            return w * 111.32 * h * 111.32 * math.cos(math.radians(middle))
        return w * h / 1e6


@dataclass
class Raster:
    """Cells (x, y, v) and their grid."""

    cells: DataFrame
    grid: Grid

    def named(self, name: str) -> DataFrame:
        return self.cells.select("x", "y", F.col("v").alias(name))


def assert_aligned(*grids: Grid, crs: bool = True) -> None:
    """Every operator over several rasters calls this."""
    first = grids[0]
    for g in grids[1:]:
        if (g.width, g.height) != (first.width, first.height):
            raise GridError(f"sizes differ: {first.width}x{first.height} and {g.width}x{g.height}")
        if crs and g.crs and first.crs and g.crs != first.crs:
            raise GridError(f"projections differ: {first.crs} and {g.crs}")


def mask_nodata(value: Column, nodata: float | None, dtype: str = "Float64") -> Column:
    """Sentinel -> NULL. A sentinel outside an unsigned type wraps as a cast would."""
    if nodata is None:
        return value
    if dtype in _WRAP:
        return F.when(value.cast("bigint") != wrap_value(int(nodata), dtype), value)
    return F.when(F.abs(value.cast("double") - F.lit(float(nodata))) >= 1e-10, value)


def wrap_value(value: int, dtype: str) -> int:
    size, half = _WRAP[dtype]
    return (value + half) % size - half


def wrap(value: Column, dtype: str) -> Column:
    """A value as the stored integer type keeps it (-9999 as Byte is 241)."""
    if dtype not in _WRAP:
        return value
    size, half = _WRAP[dtype]
    return F.pmod(value.cast("bigint") + half, F.lit(size)) - half


def hash_uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) fixed by the seed and the columns, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def order_width(rows: int) -> int:
    """Width of the grid that the orders table is laid out on."""
    return 50 if rows <= 1500 else 150 if rows <= 15000 else 500


def order_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """A land-use grid with one cell per order: two class maps, two populations, coverage and a simulated map."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.count()  # from the files' footers
    w = order_width(rows)
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    absent = key % 17 == 0
    start = F.when(~absent, (1 + cust % 6).cast("int"))
    moved = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    end = F.when(~absent, F.when(moved, (1 + (cust + F.floor(price)) % 6).cast("int")).otherwise((1 + cust % 6).cast("int")))
    factor = F.when(F.col("o_orderstatus") == "F", 1.10).when(F.col("o_orderstatus") == "P", 0.95).otherwise(1.0)
    cells = orders.select(
        (key % w).cast("int").alias("x"),
        F.floor(key / w).cast("int").alias("y"),
        start.alias("init_lu"),
        end.alias("curr_lu"),
        F.when(key % 3 == 0, end).otherwise(start).alias("sim_lu"),
        price.alias("pop0"),
        (price * factor).alias("pop1"),
        F.when(key % 5 < 2, 1).alias("buf"),
    )
    return cells, Grid(w, -(-rows // w), nodata=0, transform=(0.0, 30.0, 0.0, 0.0, 0.0, -30.0), crs="EPSG:3857")
