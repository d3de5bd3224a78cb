"""Cellular-automaton land-use simulation.

Every iteration is one frame: neighbour shares by window passes, potentials as columns, and a transition step. The exact
transition visits cells in a seeded order and updates remaining demand after each one; it needs all candidates in one
place and is bounded by ``EXACT_CELLS``. The round-based one accepts, in a few rounds and per target class, the
candidates of lowest order up to the remaining demand; it is distributed and keeps every constraint.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridError, hash_uniform
from .accuracy import step_accuracy
from .focal import class_share

EXACT_CELLS = 1_000_000


def inertia(before: float, last_gap: float, gap: float, step_size: float) -> float:
    """Factor of a class from its gap to demand now and in the last iteration."""
    if gap > 0 and gap > last_gap:
        return before * (1 + step_size / (abs(gap) + 1))
    if gap < 0 and gap < last_gap:
        return before / (1 + step_size / (abs(gap) + 1))
    return before


def potentials(cells: DataFrame, classes: list[int], dk: Mapping[int, float], mu: Mapping[int, float], seed: int, iteration: int, neighbours: int, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Adds ``op``: array of (potential, class) in class order; cells need x, y, v, pg and redline (1 allowed)."""
    shared = class_share(cells, "v", classes, neighbours, dict(weights) if weights else None)
    made = [
        F.struct(
            (F.get("pg", F.lit(k)) * (1 + F.col(f"share_{c}")) * float(dk[c]) * float(mu[c]) * F.col("redline") * hash_uniform(seed, F.lit(iteration), "x", "y", F.lit(c))).alias("p"),
            F.lit(c).alias("c"),
        )
        for k, c in enumerate(classes)
    ]
    return shared.select(*cells.columns, F.array(*made).alias("op"))


def candidates(cells: DataFrame, allowed: Mapping[int, Iterable[int]], mu: Mapping[int, float], open_classes: Iterable[int], floor: bool = True) -> DataFrame:
    """Adds ``target`` and ``best``: the allowed other class with demand left of highest positive potential."""
    open_ = sorted(open_classes)
    everything = F.lit(True)

    def fine(o):
        may = everything
        for source, targets in allowed.items():
            may = may & ((F.col("v") != source) | o["c"].isin(sorted(set(targets))))
        enough = everything
        if floor:
            for c, m in mu.items():
                enough = enough & ((o["c"] != c) | (o["p"] >= float(m)))
        return (o["p"] > 0) & (o["c"] != F.col("v")) & o["c"].isin(open_) & may & enough

    ranked = F.array_max(F.transform(F.filter("op", fine), lambda o: F.struct(o["p"].alias("p"), (-o["c"]).alias("n"))))
    return cells.withColumn("_r", ranked).withColumn("best", F.col("_r.p")).withColumn("target", -F.col("_r.n")).drop("_r")


def rounds(cells: DataFrame, left: dict[int, int], allowed: Mapping[int, Iterable[int]], mu: Mapping[int, float], seed: int, iteration: int) -> DataFrame:
    """One distributed transition step: per target the first candidates in seeded order, up to its demand."""
    chosen = candidates(cells, allowed, mu, [c for c, n in left.items() if n > 0])
    order = F.xxhash64(F.lit(seed), F.lit(iteration), "x", "y")
    wanted = chosen.filter(F.col("target").isNotNull()).select("x", "y", "target", order.alias("draw"))
    # Draws fall into buckets; their counts (a row a class and bucket) tell the bucket in which a target's demand is met.
    # Those below it win without a rank, and only that one bucket is ranked: a thousandth of a target's candidates.
    wanted = wanted.withColumn("draw", F.pmod("draw", F.lit(1 << 40))).withColumn("bucket", F.shiftright("draw", 30))
    cuts = []
    by_target: dict[int, list[tuple[int, int]]] = {}
    for r in wanted.groupBy("target", "bucket").agg(F.count("*").alias("n")).collect():
        by_target.setdefault(r["target"], []).append((r["bucket"], r["n"]))
    for target, found in by_target.items():
        rest = max(0, int(left.get(target, 0)))
        for bucket, n in sorted(found):
            if n > rest:
                cuts.append((target, bucket, rest))
                break
            rest -= n
        else:
            cuts.append((target, 1 << 11, 0))
    cut = cells.sparkSession.createDataFrame(cuts, "t int, cut bigint, rest bigint")
    close = wanted.join(F.broadcast(cut), F.col("target") == F.col("t")).filter(F.col("bucket") <= F.col("cut"))  # a row a class
    last = close.filter(F.col("bucket") == F.col("cut")).withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("draw", "x", "y"))).filter(F.col("rank") <= F.col("rest"))
    won = close.filter(F.col("bucket") < F.col("cut")).unionByName(last.drop("rank"))
    moved = won.select("x", "y", F.col("target").alias("won"))
    return cells.join(moved, ["x", "y"], "left").withColumn("v", F.coalesce("won", "v")).drop("won", "op")


def exact(cells: DataFrame, left: dict[int, int], allowed: Mapping[int, Iterable[int]], mu: Mapping[int, float], seed: int, iteration: int) -> DataFrame:
    """The sequential step: each cell in seeded order takes its best class that still has demand; bounded in size."""
    n = cells.count()
    if n > EXACT_CELLS:
        raise GridError(f"{n} cells are too many for the exact step")
    may = {k: set(t) for k, t in allowed.items()}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        remaining = dict(left)
        pdf = pdf.sort_values(["_draw", "y", "x"])
        values = pdf["v"].tolist()
        for at, (v, op) in enumerate(zip(values, pdf["op"], strict=True)):
            if v is None or v != v:
                continue
            best, to = 0.0, None
            for o in op:
                c, p = int(o["c"]), o["p"]
                if p is not None and p > best and c != v and remaining.get(c, 0) > 0 and (v not in may or c in may[v]):
                    best, to = p, c
            if to is not None and best >= mu[to]:
                remaining[to] -= 1
                if int(v) in remaining:
                    remaining[int(v)] += 1
                values[at] = to
        return pdf.assign(v=values)[["x", "y", "v"]]

    keyed = cells.withColumn("_draw", F.xxhash64(F.lit(seed), F.lit(iteration), "x", "y")).select("x", "y", F.col("v").cast("double").alias("v"), "op", "_draw", F.lit(0).alias("_all"))
    out = keyed.groupBy("_all").applyInPandas(fold, "x int, y int, v double").select("x", "y", F.col("v").cast("int").alias("new"))
    return cells.drop("v").join(out, ["x", "y"]).withColumn("v", F.col("new")).drop("new", "op")


def simulate(
    cells: DataFrame,
    demand: Mapping[int, int],
    pg_classes: list[int],
    allowed: Mapping[int, Iterable[int]] | None = None,
    mu: Mapping[int, float] | None = None,
    weights: Mapping[int, float] | None = None,
    iterations: int = 10,
    neighbours: int = 3,
    step_size: float = 400.0,
    convergence: float = 0.001,
    seed: int = 42,
    mode: str = "rounds",
    validate: DataFrame | None = None,
) -> tuple[DataFrame, list[dict]]:
    """(cells with v simulated, history of counts and metrics). ``cells``: x, y, v, pg, optional redline.

    A redline of 0 forbids change; NULL allows it. The simulation ends when every class has stayed within
    floor(convergence * cells) of its last count for three iterations.
    """
    classes = sorted(pg_classes)
    mu = dict(mu or {c: 0.0 for c in classes})
    scale = {c: (m if m > 0 else 1.0) for c, m in mu.items()}
    redline = F.when(F.col("redline").isNull() | (F.col("redline") != 0), 1.0).otherwise(0.0) if "redline" in cells.columns else F.lit(1.0)
    now = cells.select("x", "y", F.col("v").cast("int").alias("v"), "pg", redline.alias("redline")).checkpoint()
    start = now.select("x", "y", F.col("v").alias("original"))

    def counted(df):
        return {r["v"]: r["n"] for r in df.filter(F.col("v") > 0).groupBy("v").agg(F.count("*").alias("n")).collect()}

    counts = counted(now)
    total = sum(counts.values())
    dk, gaps = {c: 1.0 for c in classes}, {c: 0.0 for c in classes}
    history, calm = [], 0
    for i in range(1, iterations + 1):
        left = {c: int(demand.get(c, 0)) - counts.get(c, 0) for c in classes}
        if all(n <= 0 for n in left.values()):
            break
        for c in classes:
            dk[c] = inertia(dk[c], gaps[c], float(left[c]), step_size)
            gaps[c] = float(left[c])
        ready = potentials(now, classes, dk, scale, seed, i, neighbours, weights)
        after = (exact if mode == "exact" else rounds)(ready, left, allowed or {}, mu, seed, i).select("x", "y", "v", "pg", "redline")
        now = after.checkpoint()  # in the shared folder: a lost executor costs one iteration at most
        new = counted(now)
        row: dict = {"iteration": i, "counts": new}
        if validate is not None:
            row |= step_accuracy(now.join(start, ["x", "y"]).join(validate, ["x", "y"]), "original", "v", "real").first().asDict()
        history.append(row)
        still = all(abs(new.get(c, 0) - counts.get(c, 0)) <= int(convergence * total) for c in classes)
        calm, counts = (calm + 1 if still else 0), new
        if calm >= 3:
            break
    return now, history


def scenarios(cells: DataFrame, demands: Mapping[str, Mapping[int, int]], pg_classes: list[int], **options) -> DataFrame:
    """The same start under several demands: (scenario, x, y, v)."""
    out = None
    for name, demand in demands.items():
        own = simulate(cells, demand, pg_classes, **options)[0].select(F.lit(name).alias("scenario"), "x", "y", "v")
        out = own if out is None else out.unionByName(own)
    return out
