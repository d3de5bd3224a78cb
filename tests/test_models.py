"""Invariants of the stochastic parts."""

import pytest
from pyspark.sql import functions as F

from landloom.operators import automata, infrastructure, transition_ml


@pytest.fixture(scope="module")
def cells(spark):
    n = 12
    rows = [(x, y, 1 + (x * 7 + y * 3) % 3, 0 if x == 0 else 1, [0.2, 0.5, 0.3]) for x in range(n) for y in range(n)]
    return spark.createDataFrame(rows, "x int, y int, v int, redline int, pg array<double>").cache()


@pytest.mark.parametrize("mode", ["rounds", "exact"])
def test_automaton(cells, mode):
    counts = {r["v"]: r["n"] for r in cells.groupBy("v").agg(F.count("*").alias("n")).collect()}
    wanted = {1: counts[1] - 10, 2: counts[2] + 10, 3: counts[3]}
    run = lambda c: automata.simulate(c, wanted, [1, 2, 3], {1: [2], 2: [], 3: []}, iterations=3, mode=mode)
    out, history = run(cells)
    after = {(r["x"], r["y"]): r["v"] for r in out.collect()}
    before = {(r["x"], r["y"]): r["v"] for r in cells.collect()}
    assert len(after) == len(before) and history
    assert all(after[k] == before[k] for k in before if k[0] == 0)  # the redline
    assert all(after[k] == 2 for k in before if before[k] == 1 and after[k] != 1)  # the allowed transition
    assert list(after.values()).count(2) <= max(wanted[2], counts[2])
    again, _ = run(cells.repartition(7))
    assert {(r["x"], r["y"]): r["v"] for r in again.collect()} == after


def test_infrastructure(spark):
    cells = spark.createDataFrame([(x, y, int(x == 0), 0.0 if y == 0 else 0.9) for x in range(8) for y in range(8)], "x int, y int, v int, zone double")
    out, history = infrastructure.simulate(cells, 20, iterations=4, compat=False)
    got = {(r["x"], r["y"]): r["v"] for r in out.collect()}
    assert set(got.values()) == {0, 1} and 8 <= sum(got.values()) <= 20
    assert all(got[0, y] == 1 for y in range(8)) and all(got[x, 0] == 0 for x in range(1, 8))
    assert [h["occupied"] for h in history] == sorted(h["occupied"] for h in history)


@pytest.mark.parametrize("method", ["rf", "logit", "ann"])
def test_probabilities(spark, method):
    rows = [(x, y, 1 + (x > 9), None if x == 3 and y == 3 else 1 + (y > 9), float(y), float("nan") if (x, y) == (5, 5) else float("inf") if (x, y) == (6, 6) else float(x)) for x in range(20) for y in range(20)]
    cells = spark.createDataFrame(rows, "x int, y int, before int, after int, d0 double, d1 double")
    sample = transition_ml.samples(cells, ["d0", "d1"], cap_changed=40, cap_same=30)
    counts = {(r["label"], r["moved"]): r["n"] for r in sample.groupBy("label", "moved").agg(F.count("*").alias("n")).collect()}
    assert all(n <= (40 if moved else 30) for (_, moved), n in counts.items())
    model, classes = transition_ml.train(sample, ["d0", "d1"], method, trees=10)
    pg = transition_ml.score(cells, model, ["d0", "d1"], classes)
    got = {(r["x"], r["y"]): r["pg"] for r in pg.collect()}
    assert got[5, 5] == got[6, 6] == [0.0, 0.0]
    sums = {round(sum(p), 6) for p in got.values()}
    assert sums <= {0.0, 1.0} and classes == [1, 2]
    best = transition_ml.best_class(pg, classes).join(cells.select("x", "y", "after"), ["x", "y"]).filter("after is not null and best is not null")
    assert best.filter("best = after").count() / best.count() > 0.9
