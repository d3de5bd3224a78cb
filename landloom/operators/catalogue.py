"""The catalogue of spatial development indicators: which command computes one, and how its value becomes a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import negative_score, positive_score

#: Number, target, name, command, low and high threshold, direction (empty where none is set).
INDICATORS = """
1;2.1.2;Proportion of land for agriculture use;sdg-land-proportion;0.1;0.8;positive
2;2.1.2;Grain yield;;;;
3;2.4.1;Proportion of land for easy accessibility;sdg-buffer-zone;;;
4;2.4.1;Proportion of land for efficient irrigation practices;sdg-buffer-zone;;;
5;3.8.1;Proportion of health facility coverage;sdg-buffer-zone;;;positive
6;3.8.1;Proportion of elderly care facility coverage;sdg-buffer-zone;;;
7;3.8.1;Proportion of sport and cultural facility coverage;sdg-buffer-zone;;;
8;3.c.1;Proportion of community healthcare institution coverage;sdg-buffer-zone;;;
9;3.c.1;Proportion of city-level hospital coverage;sdg-buffer-zone;;;
10;3.c.1;Proportion of tiered hospital coverage;sdg-buffer-zone;;;
11;4.1.2;Proportion of preschool coverage;sdg-buffer-zone;;;
12;4.1.2;Proportion of primary school coverage;sdg-buffer-zone;;;
13;4.1.2;Proportion of secondary school coverage;sdg-buffer-zone;;;
14;6.6.1;Trends in water-related ecosystems over time;sdg-land-proportion;0.05;0.3;positive
15;7.2.1;Proportion of community clean energy facility coverage;sdg-buffer-zone;;;
16;9.1.1;Percentage of population residing within 2km of a road;sdg-buffer-zone;;;
17;9.1.1;Proportion of population served by subway stations;sdg-buffer-zone;;;
18;9.c.1;Proportion of population served by a mobile network;sdg-buffer-zone;;;
19;11.2.1;Proportion of population served by subway stations;sdg-buffer-zone;;;
20;11.2.1;Proportion of population served by bus stations;sdg-buffer-zone;;;
21;11.3.1;Ratio of land consumption rate to population growth rate;sdg-1131;;;neutral
22;11.7.1;Coverage rate of urban open public spaces;sdg-buffer-zone;;;
23;13.2.2;Status of achieving "Carbon Peak";sdg-1322;;;
24;14.5.1;Changes in water ecosystem within protected areas;sdg-land-conversion;0;0.3;negative
25;15.1.1;Percentage of forest area relative to total land area;sdg-land-proportion;0.05;0.5;positive
26;15.2.1;Percentage of progress towards sustainable forest management;sdg-land-conversion;;;negative
27;15.3.1;Percentage of degraded land compared to total land area;sdg-land-conversion;0;0.5;negative
"""

#: Calculation types by command; an indicator without a command of its own is a total statistic.
TYPES = {"sdg-land-proportion": "land proportion", "sdg-land-conversion": "land conversion", "sdg-buffer-zone": "buffer zone"}


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per indicator: number, target, name, command, type, low, high, direction (NULL where none is set)."""
    rows = []
    for line in INDICATORS.strip().split("\n"):
        number, target, name, run, low, high, way = line.split(";")
        rows.append((int(number), target, name, run or None, TYPES.get(run, "total statistics"), float(low) if low else None, float(high) if high else None, way or None))
    return spark.createDataFrame(rows, "number int, target string, name string, command string, type string, low double, high double, direction string")


def scored(values: DataFrame) -> DataFrame:
    """(number, value) rows joined to the catalogue, with ``score`` where thresholds and a direction are set."""
    out = values.join(F.broadcast(catalogue(values.sparkSession)), "number")  # 27 rows
    score = F.when(F.col("direction") == "positive", positive_score(F.col("value"), F.col("low"), F.col("high"))).when(
        F.col("direction") == "negative", negative_score(F.col("value"), F.col("low"), F.col("high"))
    )
    return out.withColumn("score", F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), score))
