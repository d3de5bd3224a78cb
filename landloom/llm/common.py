"""Helpers of the training-data operators: tables, shared intermediate storage, text expressions."""

from __future__ import annotations

import atexit
import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="landloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or one of our own where that is unset and the session local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{_local_fallback()}"
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _remove(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Spark's commit protocol makes the write safe when executors are lost; later stages read files that all
    executors see. The table goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_at_exit, spark, path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of finished stages now
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a frame that ``materialise`` returned (once nothing reads it any more)."""
    files = df.inputFiles()
    if files:
        _remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS, -1))


#: Rows of two longs that a filtering step may broadcast.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, bad: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys (name in ``bad`` -> expression on ``docs``) are not in ``bad``.

    The keys are counted first: few are broadcast so that texts stay where they are, many are joined by shuffle.
    """
    bad = materialise(bad.select(*keys).distinct(), "bad-keys")
    few = bad.count() <= BROADCAST_KEYS
    named = {f"_bad_{k}": k for k in keys}
    bad = bad.select(*[F.col(k).alias(n) for n, k in named.items()])
    on = None
    for n, k in named.items():
        same = keys[k].eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return docs.join(F.broadcast(bad) if few else bad, on, "left_anti")
