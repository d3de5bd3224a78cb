"""The grid of a cell table, kept beside it on whatever store the table is on."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import SparkSession

from ..grid import Grid

_NAME = "_grid.json"


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, _NAME)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_grid(spark: SparkSession, path: str, grid: Grid) -> None:
    p, fs = _place(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(dataclasses.asdict(grid)).encode()))
    out.close()


def load_grid(spark: SparkSession, path: str) -> Grid | None:
    """The grid beside a table, if there is one (a file of a few hundred bytes)."""
    p, fs = _place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    kept = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Grid(**kept | {"transform": tuple(kept["transform"])})
