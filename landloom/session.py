"""Session helpers shared by every module."""

from __future__ import annotations

import functools
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's own Parquet reader is the only way tables are opened, so any Hadoop store works.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; ``sf_dir`` may be any path or URI Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="landloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{_own_folder()}"
    return named.rstrip("/")


def local_session(cpus: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks (clusters bring their own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("landloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LANDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
