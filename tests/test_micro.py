"""The 4 x 4 fixture with known results."""

import pytest
from pyspark.sql import functions as F

from landloom.grid import Grid, GridError, Raster, assert_aligned
from landloom.operators import accuracy, indicators, markov, preprocess, priority
from landloom.operators.align import align

MAPS = {
    "i": "1122 1524 3554 0366",
    "c": "1525 1565 3554 0562",
    "s": "1522 5564 3555 0366",
    "b": "0110 0110 0010 0001",
}
P0 = [[10, 20, 30, 40], [10, 50, 30, 20], [5, 60, 70, 20], [None, 10, 5, 5]]
P1 = [[10, 25, 30, 45], [10, 55, 25, 20], [5, 66, 77, 20], [None, 12, 5, 4]]
FACTORS = {1: -1.0, 2: -20.0, 3: -5.0, 4: -0.5, 5: 5.0, 6: 0.3}
GRID = Grid(4, 4, crs="EPSG:3857", transform=(0, 30, 0, 0, 0, -30), nodata=0)


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for y in range(4):
        for x in range(4):
            values = [int(MAPS[k].split()[y][x]) or None for k in "icsb"]
            rows.append((x, y, *values, None if P0[y][x] is None else float(P0[y][x]), None if P1[y][x] is None else float(P1[y][x])))
    return spark.createDataFrame(rows, "x int, y int, i int, c int, s int, b int, p0 double, p1 double").cache()


def picture(mask, column="v"):
    got = {(r["x"], r["y"]): r[column] or 0 for r in mask.collect()}
    return " ".join("".join(str(got[x, y]) for x in range(4)) for y in range(4))


def test_indicators(cells):
    assert indicators.land_proportion(cells, [2, 3], "i").first()["score"] == pytest.approx(33.333333)
    demo = {2: [2, 5, 6], 4: [5]}
    assert indicators.land_conversion(cells, demo, "i", "c").first()[:4] == (3, 2, 150.0, 100.0)
    assert indicators.land_conversion(cells, demo, "i", "c", positive=False).first()["score"] == 0
    cli = {2: [5, 6], 4: [5]}
    assert indicators.land_conversion(cells, cli, "i", "c").first()[:4] == (3, 0, 0.0, 0.0)
    assert indicators.land_conversion(cells, cli, "i", "c", positive=False).first()["score"] == 100
    assert indicators.coverage_class(cells, [2, 3], "i", "b").first()["score"] == pytest.approx(40)
    assert indicators.coverage_population(cells, "p0", "b").first()["score"] == pytest.approx(53.246753)
    assert indicators.growth_ratio(cells, [5], ("i", "c"), ("p0", "p1"), high=3).first()["score"] == 0
    row = indicators.growth_ratio(cells, [5], ("i", "c"), ("p0", "p1")).first()
    assert (row["u0"], row["u1"], row["ratio"], row["score"]) == (3, 7, pytest.approx(21.388889), pytest.approx(79.501528))
    row = indicators.emission_change(cells, FACTORS, 0.012, "i", "c").first()
    assert (row["e0"], row["e1"], row["delta"], row["score"]) == (pytest.approx(-58.4), pytest.approx(-12.8972), pytest.approx(45.5028), 100)


def test_accuracy(cells):
    row = accuracy.change_accuracy(cells, "i", "s", "c").first()
    assert row[:4] == (4, 2, 0, 2) and row[4:] == (0.25, pytest.approx(1 / 3), 0.5)
    row = accuracy.map_agreement(cells, "i", "s", "c").first()
    assert (row["pe"], row["kappa"], row["oa"]) == (pytest.approx(0.253333, abs=1e-6), pytest.approx(0.464286, abs=1e-6), 0.6)


def test_change(cells):
    codes = sorted(r["v"] for r in preprocess.change_map(cells, "i", "c", encode=True).collect() if r["v"])
    assert codes == sorted([1005, 2005, 2006, 4005, 3005, 6002])
    assert preprocess.change_summary(cells, "i", "c").first()[:4] == (6, 1, 16, 37.5)


def test_rules_and_merge(cells):
    masks = [
        priority.loss(cells, [2, 3], "i", "c"),
        priority.converted(cells, {2: [5, 6], 4: [5]}, "i", "c"),
        priority.uncovered(cells, "i", "b", [5]),
        priority.uncovered(cells, "p0", "b", threshold=20),
        priority.emission_growth(cells, FACTORS, 1, "i", "c"),
        priority.people_and_land(cells, [5], 1, ("i", "c"), ("p0", "p1")),
    ]
    want = ["0001 0010 0000 0100", "0001 0011 0000 0000", "0000 0000 0100 0000", "0001 0001 0101 0000", "0111 0111 1100 0100", "0101 0000 0000 0000"]
    assert [picture(m) for m in masks] == want
    levels = priority.merge(masks).cache()
    assert picture(levels, "level") == "0215 0133 1301 0200"
    fixed = {r["level"]: r["n_cells"] for r in priority.level_stats(levels, GRID, compat=False).collect()}
    assert fixed == {0: 6, 1: 4, 2: 2, 3: 3, 4: 0, 5: 1, 6: 0}
    assert priority.level_summary(levels, GRID).first()[:3] == (10, 10, 100.0)
    assert priority.level_summary(levels, GRID, compat=False).first() == (16, 10, 62.5, pytest.approx(0.009))


def test_markov(cells):
    periods = {2010: Raster(cells.select("x", "y", F.col("i").alias("v")), GRID), 2020: Raster(cells.select("x", "y", F.col("c").alias("v")), GRID)}
    rows = markov.predict(periods, 2).collect()
    by = {y: [r["n"] for r in sorted(rows, key=lambda r: r["class"]) if r["year"] == y] for y in (2010, 2020, 2030, 2040)}
    assert by == {2010: [3, 3, 2, 2, 3, 2], 2020: [2, 2, 1, 1, 7, 2], 2030: [1, 2, 1, 1, 9, 2], 2040: [1, 1, 0, 0, 11, 1]}


def test_degenerate(spark, cells):
    empty = cells.limit(0)
    assert indicators.land_proportion(empty, [1], "i").first()["score"] == 0
    assert indicators.land_proportion(cells, [], "i").first()["pct"] == 0
    assert indicators.growth_ratio(cells, [5], ("i", "c"), ("p0", "p0")).first()["score"] == 0
    assert accuracy.pearson(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")).first()["r"] == 0
    assert accuracy.welch_t(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).first()["t"] == 0
    with pytest.raises(GridError):
        preprocess.normalize(empty.select("x", "y", F.col("p0").alias("v")))
    assert set(picture(priority.emission_growth(cells, FACTORS, 0, "i", "c"))) == {"0", " "}
    assert len(picture(priority.people_and_land(cells, [5], 9, ("i", "c"), ("p0", "p1")))) == 19
    with pytest.raises(GridError):
        assert_aligned(GRID, Grid(3, 4))
    stacked = align({"a": Raster(cells.select("x", "y", F.col("i").alias("v")), GRID), "b": Raster(cells.filter("x > 0").select("x", "y", F.col("c").alias("v")), GRID)})
    assert stacked.count() == 16 and stacked.filter("x = 0 and b is not null").count() == 0
    wrapped = preprocess.reclassify(cells.select("x", "y", F.col("i").alias("v")), {1: 7}, [5], dtype="Byte")
    assert {r["v"] for r in wrapped.collect()} == {7, 2, 3, 4, 241, 6, None}
