"""Registries of sessions, files and reports as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "path string, region string, category string, year int, count int, updated string"
SESSIONS = "session_id string, task string, status string, started string, finished string, summary string"


def upsert(files: DataFrame, new: DataFrame) -> DataFrame:
    """Known paths count up and have blanks filled; new ones start at 1."""
    n = new.groupBy("path").agg(*[F.max(c).alias(f"n_{c}") for c in ("region", "category", "year", "updated")], F.count("*").cast("int").alias("n_seen"))
    out = files.join(n, "path", "full_outer")

    def filled(c):
        return F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"n_{c}")).alias(c)

    return out.select(
        "path",
        *[filled(c) for c in ("region", "category", "year")],
        (F.coalesce("count", F.lit(0)) + F.coalesce("n_seen", F.lit(0))).cast("int").alias("count"),
        F.greatest("updated", "n_updated").alias("updated"),
    )


def listed(files: DataFrame, region: str | None = None, category: str | None = None, year: int | None = None) -> DataFrame:
    for name, want in (("region", region), ("category", category), ("year", year)):
        if want is not None:
            files = files.filter(F.col(name) == want)
    return files


def stale(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries whose path is gone."""
    return files.join(existing.select("path").distinct(), "path", "left_anti")


def reports(rows: DataFrame, region: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Newest first."""
    for name, want in (("region", region), ("kind", kind)):
        if want is not None:
            rows = rows.filter(F.col(name) == want)
    return rows.orderBy(F.col("created").desc(), "report_id").limit(limit)


def latest(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.orderBy(F.col("started").desc(), "session_id").limit(limit)


def current(events: DataFrame) -> DataFrame:
    """Session events (start, update, finish rows) -> the last non-blank value of each field per session."""
    fields = [c for c in events.columns if c not in ("session_id", "at")]
    return events.groupBy("session_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in fields])


def archive(sessions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Finished sessions with their vectors, matched by session id."""
    return sessions.filter(F.col("status") == "finished").join(vectors, "session_id", "left")


def preferences(saved: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Saved values over the defaults: (name, value)."""
    base = saved.sparkSession.createDataFrame(sorted(defaults.items()), "name string, fallback string")
    return base.join(saved, "name", "full_outer").select("name", F.coalesce("value", "fallback").alias("value"))
