"""Growth of one infrastructure type over a zone of suitability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import hash_uniform
from .accuracy import binary_accuracy
from .focal import ring_sum


def occupied(value, code: int = 1):
    """1 where the value is the infrastructure's code, else 0; NoData is 0."""
    return F.coalesce((value == code).cast("int"), F.lit(0))


def inertia(gap: float, iteration: int, decay: float = 0.92) -> float:
    if gap == 0:
        return 0.0
    return min(1.0, max(0.0, 1 - decay**iteration * gap / (gap + 1)))


def simulate(
    cells: DataFrame, demand: int, iterations: int = 10, neighbours: int = 3, decay: float = 0.92, convergence: float = 0.001, seed: int = 42, compat: bool = True, validate: DataFrame | None = None
) -> tuple[DataFrame, list[dict]]:
    """(cells x, y, v in {0, 1}; history). ``cells``: x, y, v, zone.

    Potentials are zone times neighbour share times inertia over their sum; a free cell is taken where its potential
    exceeds a seeded uniform draw, highest potential first, up to the remaining demand. With ``compat`` potentials sum
    to 1, so hardly more than one cell is taken an iteration; without, they are scaled to expect the remaining demand.
    """
    now = cells.select("x", "y", occupied(F.col("v")).alias("v"), F.coalesce(F.col("zone").cast("double"), F.lit(0.0)).alias("zone")).checkpoint()
    half = (neighbours - 1) // 2
    history, calm = [], 0
    have = now.agg(F.sum("v")).first()[0] or 0
    for i in range(1, iterations + 1):
        gap = demand - have
        if gap <= 0:
            break
        around = ring_sum(now.withColumn("cell", F.lit(1)), ["v", "cell"], half)
        share = F.when(F.col("v") == 1, 1.0).otherwise(F.coalesce(F.try_divide(F.col("box_v").cast("double"), F.col("box_cell")), F.lit(0.0)))
        scored = around.select("x", "y", "v", "zone", (F.col("zone") * share * inertia(float(gap), i, decay)).alias("op"))
        total = scored.agg(F.sum("op")).first()[0] or 0.0
        if total < 1e-10:
            break
        chance = F.col("op") / total * (1.0 if compat else float(gap))
        drawn = scored.filter((F.col("v") == 0) & (chance > hash_uniform(seed, F.lit(i), "x", "y")))
        # Each draw is independent, so the visit in descending order is a rank; only the drawn cells are ranked, and
        # the limit is the demand itself.
        taken = drawn.orderBy(F.col("op").desc(), "y", "x").limit(int(gap)).select("x", "y", F.lit(1).alias("new"))
        now = now.join(taken, ["x", "y"], "left").select("x", "y", F.coalesce("new", "v").alias("v"), "zone").checkpoint()
        have = now.agg(F.sum("v")).first()[0] or 0
        row: dict = {"iteration": i, "occupied": have}
        if validate is not None:
            row |= binary_accuracy(now.join(validate, ["x", "y"]), "v", "real").first().asDict()
        history.append(row)
        calm = calm + 1 if abs(have - demand) / max(1, demand) < convergence else 0
        if calm >= 3:
            break
    return now.select("x", "y", "v"), history
