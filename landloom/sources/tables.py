"""Text sources and sinks: demand tables, reclass rules, logs with checkpoints, key=value results."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridError


def write_demand(demand: DataFrame, path: str) -> None:
    """(year, class, n) -> a wide CSV of Year, Type<k>..., by year."""
    from ..operators.markov import wide

    wide(demand).orderBy("Year").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row per year


def read_demand(spark: SparkSession, path: str, classes: list[int], year: int = 0) -> dict[int, int]:
    """Counts of a year (0: the last) by class; columns belong to the classes in ascending order, whatever their names."""
    df = spark.read.option("header", True).csv(path)
    named = df.select(F.col(df.columns[0]).try_cast("int").alias("year"), *[F.col(c).try_cast("bigint").alias(f"c{k}") for k, c in enumerate(df.columns[1:])]).filter("year is not null")
    if year:
        named = named.filter(F.col("year") == year)
    row = named.orderBy(F.col("year").desc()).limit(1).first()
    if row is None:
        raise GridError(f"no demand for {year or 'any year'}")
    return {c: int(row[k + 1] or 0) for k, c in enumerate(sorted(classes)) if k + 1 < len(row)}


def read_binary_demand(spark: SparkSession, path: str, year: int = 0) -> int:
    """The second column of the year's row, else of the last row; comments and rows without numbers are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", ",").alias("p")).filter(~F.col("p")[0].startswith("#"))
    rows = lines.select("line", F.get("p", F.lit(0)).try_cast("int").alias("year"), F.get("p", F.lit(1)).try_cast("bigint").alias("n")).filter("year is not null and n is not null")
    best = rows.agg(F.max_by("n", "line").alias("last"), F.max_by(F.when(F.col("year") == year, F.col("n")), F.when(F.col("year") == year, F.col("line"))).alias("own")).first()
    if best["last"] is None:
        raise GridError("no demand row")
    return int(best["own"] if year and best["own"] is not None else best["last"])


def read_reclass(path: str) -> tuple[dict[int, int], list[int]]:
    """A rule file {"remap": {...}, "nodata": [...]}."""
    with open(path) as f:
        rule = json.load(f)
    return {int(k): int(v) for k, v in rule.get("remap", {}).items()}, [int(x) for x in rule.get("nodata", [])]


def last_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The last ``CHECKPOINT step=.. total=.. message=..`` line of a log."""
    pattern = r"CHECKPOINT step=(\d+) total=(\d+) message=(.*)$"
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value").filter(F.col("value").rlike(pattern))
    return lines.agg(F.max_by("value", "line").alias("value")).filter("value is not null").select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("step"), F.regexp_extract("value", pattern, 2).cast("int").alias("total"), F.regexp_extract("value", pattern, 3).alias("message")
    )


def checkpoint_line(step: int, total: int, message: str) -> str:
    return f"CHECKPOINT step={step} total={total} message={message}"


def result_lines(values: dict[str, float], digits: int = 4) -> str:
    return "\n".join(f"{k}={v:.{digits}f}" if isinstance(v, float) else f"{k}={v}" for k, v in values.items())


def parse_result(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in re.findall(r"(\w+)=(-?[\d.]+)", text)}


def literal_samples(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two comma-separated series -> (a, b) rows."""
    from ..functions.parse import numbers

    a, b = numbers(first), numbers(second)
    if len(a) != len(b):
        raise GridError("the series differ in length")
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double")
