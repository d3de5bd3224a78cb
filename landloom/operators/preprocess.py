"""Raster preparation: normalise, reclassify, detect change, re-encode."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import GridError, wrap


def normalize(cells: DataFrame, low: float = 0.0, high: float = 1.0, minimum: float | None = None, maximum: float | None = None) -> DataFrame:
    """Min-max scaling to float; bounds may be given. NoData stays; a constant band becomes all 0, NoData too."""
    v = F.col("v").cast("double")
    if minimum is None or maximum is None:
        found = cells.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
        if found["a"] is None and (minimum is None or maximum is None):
            raise GridError("the band has no valid cell")
        minimum, maximum = (found["a"] if minimum is None else minimum), (found["b"] if maximum is None else maximum)
    if abs(maximum - minimum) < 1e-15:
        return cells.select("x", "y", F.lit(0.0).cast("float").alias("v"))
    return cells.select("x", "y", ((v - minimum) / (maximum - minimum) * (high - low) + low).cast("float").alias("v"))


def reclassify(cells: DataFrame, remap: Mapping[int, int], nodata_classes: Iterable[int] = (), nodata: int = -9999, dtype: str = "Int32") -> DataFrame:
    """Mapped classes first, then classes marked as NoData, else unchanged; as the stored type keeps it."""
    v = F.col("v").cast("bigint")
    out = F.when(v.isin(sorted(set(nodata_classes))), F.lit(nodata).cast("bigint")).otherwise(v) if nodata_classes else v
    if remap:
        pairs = [F.lit(int(x)).cast("bigint") for kv in sorted(remap.items()) for x in kv]
        out = F.coalesce(F.try_element_at(F.create_map(*pairs), v), out)
    return cells.select("x", "y", wrap(out, dtype).alias("v"))


def reclass_counts(cells: DataFrame, remap: Mapping[int, int]) -> DataFrame:
    """How many cells each mapped class had."""
    v = F.col("v").cast("bigint")
    return cells.filter(v.isin(sorted(remap))).groupBy(v.alias("class")).agg(F.count("*").alias("n"))


def change_map(cells: DataFrame, before: str = "before", after: str = "after", encode: bool = False) -> DataFrame:
    """1 (or before * 1000 + after) where valid and different, else 0; NoData is 0 too."""
    a, b = F.col(before), F.col(after)
    code = (a.cast("bigint") * 1000 + b) if encode else F.lit(1).cast("bigint")
    return cells.select("x", "y", F.when(F.coalesce(a != b, F.lit(False)), code).otherwise(0).alias("v"))


def change_summary(cells: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Changed and NoData cells, and the changed share of all cells."""
    a, b = F.col(before), F.col(after)
    out = cells.agg(F.count_if(F.coalesce(a != b, F.lit(False))).alias("n_changed"), F.count_if(a.isNull() | b.isNull()).alias("n_nodata"), F.count("*").alias("n_all"))
    return out.withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("n_changed"), F.col("n_all")), F.lit(0.0)))


#: Codecs of the sink by their raster names.
CODECS = {"deflate": "gzip", "zstd": "zstd", "lzw": "snappy", "lerc": "gzip", "lerc_zstd": "zstd", "none": "none"}


def compress(cells: DataFrame, path: str, codec: str = "zstd", level: int | None = None, max_error: float = 0.0, overviews: Iterable[int] = ()) -> dict[str, int]:
    """Write a cell table (and overview tables under it) with a codec; lossy codecs round to twice the error.

    Returns the bytes written by level; 1 is the full table.
    """
    from .align import overview

    if codec not in CODECS:
        raise GridError(f"unknown codec {codec}")
    if codec.startswith("lerc") and max_error > 0:
        cells = cells.withColumn("v", F.round(F.col("v") / (2 * max_error)) * (2 * max_error))
    spark, sizes = cells.sparkSession, {}
    for factor in (1, *overviews):
        out = f"{path}/level={factor}"
        writer = (cells if factor == 1 else overview(cells, factor)).write.mode("overwrite").option("compression", CODECS[codec])
        if level is not None and CODECS[codec] == "zstd":
            writer = writer.option("parquet.compression.codec.zstd.level", str(level))
        writer.parquet(out)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        sizes[str(factor)] = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return sizes
