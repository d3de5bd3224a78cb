"""Registered queries of the land-use engine and their DuckDB oracles.

The rasters of these queries are one grid laid out from the orders table (see ``grid.order_grid``); the oracle builds
the same grid in SQL. Counts are BIGINT and scores are DOUBLE rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Grid, Raster, order_grid, wrap
from .operators import accuracy, automata, catalogue, charts, indicators, infrastructure, inspection, knowledge, manifest, markov, preprocess, priority, registry, reports, rules, transition_ml
from .operators.align import align, mask_by, overview, resample
from .operators.focal import class_share
from .functions import parse
from .session import shared_folder, table
from .sources.geotiff import write_geotiff

#: The demonstration's parameters.
FACTORS = {1: -1.0, 2: -20.0, 3: -5.0, 4: -0.5, 5: 5.0, 6: 0.3}
MOVES = {2: [2, 5, 6], 4: [5]}
RATIO = 0.012

GRID = """s AS (SELECT CASE WHEN count(*) <= 1500 THEN 50 WHEN count(*) <= 15000 THEN 150 ELSE 500 END AS w FROM orders),
g AS (SELECT k, k % w AS x, k // w AS y, i AS init_lu, CASE WHEN i IS NOT NULL THEN CASE WHEN hot THEN 1 + (c + p) % 6 ELSE i END END AS curr_lu,
  CASE WHEN k % 3 = 0 THEN CASE WHEN i IS NOT NULL THEN CASE WHEN hot THEN 1 + (c + p) % 6 ELSE i END END ELSE i END AS sim_lu,
  pop0, pop0 * f AS pop1, CASE WHEN k % 5 < 2 THEN 1 END AS buf
  FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, o_totalprice AS pop0, w, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hot,
    CASE WHEN o_orderkey % 17 <> 0 THEN 1 + o_custkey % 6 END AS i, CASE o_orderstatus WHEN 'F' THEN 1.10::DOUBLE WHEN 'P' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS f FROM orders, s))"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = f"WITH {GRID} {sql}" if " g" in sql or sql.startswith(",") else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _cells(spark, sf_dir, **names) -> DataFrame:
    cells, _ = order_grid(spark, sf_dir)
    return cells.select("x", "y", *[F.col(c).alias(n) for n, c in names.items()]) if names else cells


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names or df.columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, the six rules, their merge and level statistics of one grid."""
    cells, grid = order_grid(spark, sf_dir)
    masks = _masks(cells)
    levels = priority.level_stats(priority.merge(masks), grid, compat=False)
    scores = indicators.land_proportion(cells, [2, 3], "curr_lu").select(F.col("score").alias("proportion"))
    scores = scores.join(indicators.land_conversion(cells, MOVES, "init_lu", "curr_lu").select(F.col("score").alias("conversion")))  # one row each
    scores = scores.join(indicators.coverage_population(cells, "pop0", "buf").select(F.col("score").alias("coverage")))
    return levels.join(F.broadcast(scores)).orderBy("level")


def _masks(cells: DataFrame) -> list[DataFrame]:
    return [
        priority.loss(cells, [2, 3], "init_lu", "curr_lu"),
        priority.converted(cells, MOVES, "init_lu", "curr_lu"),
        priority.uncovered_class(cells, [5], "init_lu"),
        priority.uncovered_population(cells, 250000, "pop0"),
        priority.emission_growth(cells, FACTORS, 3, "init_lu", "curr_lu"),
        priority.people_and_land(cells, [5], 3, ("init_lu", "curr_lu"), ("pop0", "pop1")),
    ]


# Scores in SQL, over pct with bounds.
def _pos(pct: str, low: str = "0", high: str = "100") -> str:
    return f"greatest(0.0, least(100.0, ({pct} - {low}) / ({high} - {low}) * 100.0))"


@query("SELECT n_class, n_valid, round(100.0 * n_class / n_valid, 6) AS pct, round(100.0 * n_class / n_valid, 6) AS score FROM (SELECT count(*) FILTER (init_lu IN (2, 3)) AS n_class, count(init_lu) AS n_valid FROM g)")
def land_proportion(spark, sf_dir):
    return indicators.land_proportion(_cells(spark, sf_dir), [2, 3], "init_lu").select("n_class", "n_valid", _r("pct"), _r("score"))


_CONV = "SELECT count(*) FILTER (init_lu <> curr_lu AND ((init_lu = 2 AND curr_lu IN (2, 5, 6)) OR (init_lu = 4 AND curr_lu = 5))) AS n_converted, count(*) FILTER ({base}) AS n_base FROM g"
_CONV_OUT = "SELECT n_converted, n_base, round(pct, 6) AS pct, round({score}, 6) AS score FROM (SELECT *, 100.0 * n_converted / n_base AS pct FROM ({inner}))"


@query(_CONV_OUT.format(score=_pos("pct"), inner=_CONV.format(base="init_lu <> curr_lu AND init_lu = 2")))
def land_conversion_pos(spark, sf_dir):
    return indicators.land_conversion(_cells(spark, sf_dir), MOVES, "init_lu", "curr_lu").select("n_converted", "n_base", _r("pct"), _r("score"))


@query(_CONV_OUT.format(score="100 - " + _pos("pct"), inner=_CONV.format(base="init_lu <> curr_lu AND init_lu = 2")))
def land_conversion_neg(spark, sf_dir):
    return indicators.land_conversion(_cells(spark, sf_dir), MOVES, "init_lu", "curr_lu", positive=False).select("n_converted", "n_base", _r("pct"), _r("score"))


@query(_CONV_OUT.format(score=_pos("pct"), inner=_CONV.format(base="init_lu IN (2, 4) AND curr_lu IS NOT NULL")))
def land_conversion_fixed(spark, sf_dir):
    return indicators.land_conversion(_cells(spark, sf_dir), MOVES, "init_lu", "curr_lu", compat=False).select("n_converted", "n_base", _r("pct"), _r("score"))


@query("SELECT covered, total, round(100.0 * covered / total, 6) AS pct, round(100.0 * covered / total, 6) AS score FROM (SELECT CAST(count(*) FILTER (init_lu IN (2, 3) AND buf IS NOT NULL) AS DOUBLE) AS covered, CAST(count(*) FILTER (init_lu IN (2, 3)) AS DOUBLE) AS total FROM g)")
def buffer_class(spark, sf_dir):
    return indicators.coverage_class(_cells(spark, sf_dir), [2, 3], "init_lu").select("covered", "total", _r("pct"), _r("score"))


@query("SELECT round(100.0 * sum(pop0) FILTER (buf IS NOT NULL) / sum(pop0), 6) AS pct, round(100.0 * sum(pop0) FILTER (buf IS NOT NULL) / sum(pop0), 6) AS score FROM g")
def buffer_population(spark, sf_dir):
    return indicators.coverage_population(_cells(spark, sf_dir), "pop0").select(_r("pct"), _r("score"))


_GROWTH = "SELECT *, ((u1 - u0) / u0) / ((p1 - p0) / p0) AS ratio FROM (SELECT CAST(count(*) FILTER (init_lu = 5) AS DOUBLE) u0, CAST(count(*) FILTER (curr_lu = 5) AS DOUBLE) u1, sum(pop0) p0, sum(pop1) p1 FROM g)"


@query(f"SELECT u0, u1, round(ratio, 6) AS ratio, round(CASE WHEN ratio < 0 OR ratio > 100 THEN 0.0 WHEN ratio <= 1.12 THEN ratio / 1.12 * 100 ELSE (100 - ratio) / (100 - 1.12) * 100 END, 6) AS score FROM ({_GROWTH})")
def growth_ratio_1131(spark, sf_dir):
    return indicators.growth_ratio(_cells(spark, sf_dir), [5], ("init_lu", "curr_lu"), ("pop0", "pop1")).select("u0", "u1", _r("ratio"), _r("score"))


def _factor_sql(column: str, factors: dict) -> str:
    return "(CASE " + column + " " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in factors.items()) + " ELSE 0.0::DOUBLE END)"


@query(f"SELECT round(e0, 6) AS e0, round(e1, 6) AS e1, round(e1 - e0, 6) AS delta, round(CASE WHEN e1 - e0 <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (e1 - e0) / least(abs(e0), abs(e1)) * 100)) END, 6) AS score FROM (SELECT sum({_factor_sql('init_lu', FACTORS)}) AS e0, sum({_factor_sql('curr_lu', {k: v * (1 - RATIO) if v > 0 else v * (1 + RATIO) for k, v in FACTORS.items()})}) AS e1 FROM g)")
def emission_1322(spark, sf_dir):
    return indicators.emission_change(_cells(spark, sf_dir), FACTORS, RATIO, "init_lu", "curr_lu").select(_r("e0"), _r("e1"), _r("delta"), _r("score"))


@query("SELECT round(CASE WHEN r >= 0.1 THEN r ELSE 0 END, 6) AS share FROM (SELECT count(*) FILTER (init_lu = 2) / count(init_lu) AS r FROM g)")
def forest_minimum_share(spark, sf_dir):
    return indicators.minimum_share(_cells(spark, sf_dir), [2], 0.1, "init_lu").select(_r("share"))


_CONFUSION = "SELECT count(*) FILTER (curr_lu <> init_lu AND sim_lu = init_lu) a, count(*) FILTER (curr_lu <> init_lu AND sim_lu = curr_lu) b, count(*) FILTER (curr_lu <> init_lu AND sim_lu <> init_lu AND sim_lu <> curr_lu) c, count(*) FILTER (curr_lu = init_lu AND sim_lu <> init_lu) d FROM g WHERE init_lu IS NOT NULL AND curr_lu IS NOT NULL AND sim_lu IS NOT NULL"


def _three(spark, sf_dir):
    return _cells(spark, sf_dir, original="init_lu", simulated="sim_lu", real="curr_lu")


@query(f"SELECT a, b, c, d, round(b / (a + b + c + d), 6) AS fom, round(b / (a + b + c), 6) AS pa, round(b / (b + c + d), 6) AS ua FROM ({_CONFUSION})")
def accuracy_fom(spark, sf_dir):
    return accuracy.change_accuracy(_three(spark, sf_dir)).select("a", "b", "c", "d", _r("fom"), _r("pa"), _r("ua"))


@query(", v AS (SELECT sim_lu s, curr_lu r FROM g WHERE sim_lu IS NOT NULL AND curr_lu IS NOT NULL AND init_lu IS NOT NULL), m AS (SELECT sum(ns) n, sum(ns * nr) x FROM (SELECT r, CAST(count(*) AS DOUBLE) nr FROM v GROUP BY r) JOIN (SELECT s, CAST(count(*) AS DOUBLE) ns FROM v GROUP BY s) ON r = s), k AS (SELECT (SELECT count(*) FROM v WHERE s = r) / (SELECT count(*) FROM v) po, x / (n * n) pe, (SELECT count(*) FROM v WHERE s = r) / n oa FROM m) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round(oa, 6) AS oa, round((po - pe) / (1 - pe), 6) AS kappa FROM k")
def accuracy_kappa(spark, sf_dir):
    return accuracy.map_agreement(_three(spark, sf_dir)).select(_r("po"), _r("pe"), _r("oa"), _r("kappa"))


@query("SELECT a, b, c, d, round(a / (a + b + c), 6) AS fom, round(a / (a + b), 6) AS pa, round(a / (a + c), 6) AS ua FROM (SELECT count(*) FILTER (curr_lu <> init_lu AND sim_lu = curr_lu) a, count(*) FILTER (curr_lu <> init_lu AND sim_lu = init_lu) b, count(*) FILTER (sim_lu <> init_lu AND sim_lu <> curr_lu) c, count(*) FILTER (curr_lu = init_lu AND sim_lu = init_lu) d FROM g)")
def accuracy_step(spark, sf_dir):
    return accuracy.step_accuracy(_three(spark, sf_dir)).select("a", "b", "c", "d", _r("fom"), _r("pa"), _r("ua"))


_TWO = "round((a + d) / n, 6) AS oa, round(((a + d) / n - pe) / (1 - pe), 6) AS kappa"


@query(f"SELECT a, b, c, d, {_TWO} FROM (SELECT *, a + b + c + d AS n, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS pe FROM (SELECT count(*) FILTER (curr_lu <> init_lu AND sim_lu <> init_lu) a, count(*) FILTER (curr_lu <> init_lu AND sim_lu = init_lu) b, count(*) FILTER (curr_lu = init_lu AND sim_lu <> init_lu) c, count(*) FILTER (curr_lu = init_lu AND sim_lu = init_lu) d FROM g))")
def accuracy_change_binary(spark, sf_dir):
    return accuracy.binary_change_accuracy(_three(spark, sf_dir), "original", "simulated", "real").select("a", "b", "c", "d", _r("oa"), _r("kappa"))


@query(f"SELECT a, b, c, d, {_TWO}, round(a / (a + b), 6) AS pa, round(a / (a + c), 6) AS ua, round(a / (a + c + 0.1), 6) AS fom FROM (SELECT *, a + b + c + d AS n, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS pe FROM (SELECT count(*) FILTER (p AND r) a, count(*) FILTER (NOT p AND r) b, count(*) FILTER (p AND NOT r) c, count(*) FILTER (NOT p AND NOT r) d FROM (SELECT coalesce(sim_lu = 5, false) p, coalesce(curr_lu = 5, false) r FROM g)))")
def accuracy_infrastructure(spark, sf_dir):
    cells = _cells(spark, sf_dir).select(infrastructure.occupied(F.col("sim_lu"), 5).alias("p"), infrastructure.occupied(F.col("curr_lu"), 5).alias("r"))
    return accuracy.binary_accuracy(cells, "p", "r").select("a", "b", "c", "d", _r("oa"), _r("kappa"), _r("pa"), _r("ua"), _r("fom"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, sf_dir):
    return accuracy.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(_r("r"))


@query("SELECT round((avg(l_discount) - avg(l_tax)) / sqrt(var_samp(l_discount) / count(l_discount) + var_samp(l_tax) / count(l_tax)), 6) AS t FROM lineitem")
def welch_t(spark, sf_dir):
    return accuracy.welch_t(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").select(_r("t"))


@query("SELECT x, y, CAST(CASE WHEN init_lu <> curr_lu THEN 1 ELSE 0 END AS BIGINT) AS v FROM g")
def detect_change_binary(spark, sf_dir):
    return _long(preprocess.change_map(_cells(spark, sf_dir), "init_lu", "curr_lu"))


@query("SELECT x, y, CAST(CASE WHEN init_lu <> curr_lu THEN init_lu * 1000 + curr_lu ELSE 0 END AS BIGINT) AS v FROM g")
def detect_change_encoded(spark, sf_dir):
    return _long(preprocess.change_map(_cells(spark, sf_dir), "init_lu", "curr_lu", encode=True))


@query("SELECT n_changed, n_nodata, n_all, round(100.0 * n_changed / n_all, 6) AS pct FROM (SELECT count(*) FILTER (init_lu <> curr_lu) n_changed, count(*) FILTER (init_lu IS NULL OR curr_lu IS NULL) n_nodata, count(*) n_all FROM g)")
def change_summary(spark, sf_dir):
    return preprocess.change_summary(_cells(spark, sf_dir), "init_lu", "curr_lu").select("n_changed", "n_nodata", "n_all", _r("pct"))


@query("SELECT x, y, round(CAST(CAST((pop0 - a) / (b - a) AS FLOAT) AS DOUBLE), 5) AS v FROM g, (SELECT min(pop0) a, max(pop0) b FROM g)")
def normalize_minmax(spark, sf_dir):
    out = preprocess.normalize(_cells(spark, sf_dir, v="pop0"))
    return _long(out, "x", "y").withColumn("v", F.round(F.col("v").cast("double"), 5))


@query("SELECT x, y, CAST(CASE WHEN init_lu IN (1, 2) THEN 10 WHEN init_lu = 3 THEN 20 WHEN init_lu IN (5, 6) THEN 241 ELSE init_lu END AS BIGINT) AS v FROM g")
def reclass(spark, sf_dir):
    return _long(preprocess.reclassify(_cells(spark, sf_dir, v="init_lu"), {1: 10, 2: 10, 3: 20}, [5, 6], -9999, "Byte"))


@query("SELECT init_lu AS class, count(*) AS n FROM g WHERE init_lu IN (1, 2, 3) GROUP BY 1")
def reclass_counts(spark, sf_dir):
    return preprocess.reclass_counts(_cells(spark, sf_dir, v="init_lu"), {1: 10, 2: 10, 3: 20})


@query("SELECT count(*) AS n_all, count(init_lu) AS n_valid, CAST(min(init_lu) AS DOUBLE) AS min, CAST(max(init_lu) AS DOUBLE) AS max, round(avg(init_lu), 6) AS mean, round(100.0 * (count(*) - count(init_lu)) / count(*), 6) AS nodata_pct, false AS all_zero, false AS all_same FROM g")
def band_stats(spark, sf_dir):
    return inspection.band_stats(_cells(spark, sf_dir), "init_lu").select("n_all", "n_valid", "min", "max", _r("mean"), _r("nodata_pct"), "all_zero", "all_same")


@query("SELECT init_lu AS class, count(*) AS n FROM g WHERE init_lu IS NOT NULL GROUP BY 1")
def class_coverage(spark, sf_dir):
    return inspection.classes(_cells(spark, sf_dir), "init_lu")


@query("SELECT e AS class FROM (SELECT unnest([1, 5, 7, 9])::BIGINT AS e) WHERE e NOT IN (SELECT init_lu FROM g WHERE init_lu IS NOT NULL)")
def missing_types(spark, sf_dir):
    return inspection.missing_classes(_cells(spark, sf_dir), [1, 5, 7, 9], "init_lu")


@query("SELECT count(*) AS n_all, count(init_lu) AS n_valid, array_to_string([]::VARCHAR[], ',') AS errors, 'type_missing' AS warnings FROM g")
def inspect_report(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    out = inspection.inspect(cells, grid, grid, [1, 7], "init_lu")
    return out.select("n_all", "n_valid", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def _mask(df: DataFrame) -> DataFrame:
    return df.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v"))


_R1 = "CAST(coalesce(init_lu <> curr_lu AND init_lu IN (2, 3), false) AS BIGINT)"
_R2 = "CAST(coalesce(init_lu <> curr_lu AND ((init_lu = 2 AND curr_lu IN (2, 5, 6)) OR (init_lu = 4 AND curr_lu = 5)), false) AS BIGINT)"
_R3 = "CAST(coalesce(buf IS NULL AND init_lu = 5, false) AS BIGINT)"
_R4 = "CAST(buf IS NULL AND pop0 >= 250000 AS BIGINT)"


def _box(columns: str, low: str, high: str, source: str) -> str:
    """Two window passes in SQL; ``columns`` are names of the source."""
    names = columns.split()
    one = ", ".join(f"sum({c}) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {low} PRECEDING AND {high} FOLLOWING) AS a_{c}" for c in names)
    two = ", ".join(f"sum(a_{c}) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {low} PRECEDING AND {high} FOLLOWING) AS box_{c}" for c in names)
    return f"SELECT *, {two} FROM (SELECT *, {one} FROM ({source}))"


_GAIN = f"CAST(round(10 * ({_factor_sql('curr_lu', {k: k * v for k, v in FACTORS.items()})} - {_factor_sql('init_lu', {k: k * v for k, v in FACTORS.items()})})) AS BIGINT)"
_R5_SQL = f"SELECT x, y, CAST(init_lu IS NOT NULL AND box_d > 0 AS BIGINT) AS v FROM ({_box('d', '2', '3', f'SELECT *, CASE WHEN x > 0 AND y > 0 THEN {_GAIN} ELSE 0 END AS d FROM g')})"
_SEEN = "init_lu IS NOT NULL AND curr_lu IS NOT NULL"
_R6_SQL = f"SELECT x, y, CAST({_SEEN} AND ((box_dp - dp > 0) <> (box_u0 - u0 <= box_u1 - u1)) AS BIGINT) AS v FROM ({_box('u0 u1 dp', '3', '3', f'SELECT *, CASE WHEN {_SEEN} AND init_lu = 5 THEN 1 ELSE 0 END AS u0, CASE WHEN {_SEEN} AND curr_lu = 5 THEN 1 ELSE 0 END AS u1, CASE WHEN {_SEEN} THEN pop1 - pop0 ELSE 0 END AS dp FROM g')})"


@query(f"SELECT x, y, {_R1} AS v FROM g")
def rule1_loss(spark, sf_dir):
    return _mask(priority.loss(_cells(spark, sf_dir), [2, 3], "init_lu", "curr_lu"))


@query(f"SELECT x, y, {_R2} AS v FROM g")
def rule2_transition(spark, sf_dir):
    return _mask(priority.converted(_cells(spark, sf_dir), MOVES, "init_lu", "curr_lu"))


@query(f"SELECT x, y, {_R3} AS v FROM g")
def rule3_outside_class(spark, sf_dir):
    return _mask(priority.uncovered_class(_cells(spark, sf_dir), [5], "init_lu"))


@query(f"SELECT x, y, {_R4} AS v FROM g")
def rule4_outside_pop(spark, sf_dir):
    return _mask(priority.uncovered(_cells(spark, sf_dir), "pop0", threshold=250000))


@query(_R5_SQL)
def rule5_emission(spark, sf_dir):
    return _mask(priority.emission_growth(_cells(spark, sf_dir), FACTORS, 3, "init_lu", "curr_lu"))


@query(_R6_SQL)
def rule6_human_land(spark, sf_dir):
    return _mask(priority.people_and_land(_cells(spark, sf_dir), [5], 3, ("init_lu", "curr_lu"), ("pop0", "pop1")))


_MERGED = f"SELECT x, y, CAST(sum(v) AS BIGINT) AS level FROM (" + " UNION ALL ".join([*(f"SELECT x, y, {r} AS v FROM g" for r in (_R1, _R2, _R3, _R4)), f"({_R5_SQL})", f"({_R6_SQL})"]) + ") GROUP BY x, y"


@query(_MERGED)
def priority_merge(spark, sf_dir):
    return _long(priority.merge(_masks(_cells(spark, sf_dir))))


@query(f"SELECT l AS level, count(level) AS n_cells, round(CAST(count(level) AS DOUBLE) * 0.0009::DOUBLE, 6) AS km2 FROM (SELECT unnest(range(7)) AS l) LEFT JOIN (SELECT level FROM ({_MERGED}) WHERE level > 0) ON l = level GROUP BY l")
def priority_stats(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    return priority.level_stats(priority.merge(_masks(cells)), grid).select(F.col("level").cast("bigint").alias("level"), "n_cells", _r("km2"))


@query(f"SELECT count(*) AS total, count(*) FILTER (level > 0) AS priority, round(100.0 * count(*) FILTER (level > 0) / count(*), 6) AS pct, round(CAST(count(*) FILTER (level > 0) AS DOUBLE) * 0.0009::DOUBLE, 6) AS priority_km2 FROM ({_MERGED})")
def priority_summary_fixed(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    return priority.level_summary(priority.merge(_masks(cells)), grid, compat=False).select("total", "priority", _r("pct"), _r("priority_km2"))


def _periods(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    return {2010: Raster(cells.select("x", "y", F.col("init_lu").alias("v")), grid), 2020: Raster(cells.select("x", "y", F.col("curr_lu").alias("v")), grid)}


@query("SELECT year, v AS class, count(*) AS n FROM (SELECT 2010 AS year, init_lu AS v FROM g UNION ALL SELECT 2020, curr_lu FROM g) WHERE v > 0 GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    p = _periods(spark, sf_dir)
    return markov.class_counts(p[2010].cells.withColumn("year", F.lit(2010)).unionByName(p[2020].cells.withColumn("year", F.lit(2020))))


_CROSS = "SELECT init_lu AS \"from\", curr_lu AS \"to\", count(*) AS n FROM g WHERE init_lu > 0 AND curr_lu > 0 GROUP BY 1, 2"


@query(_CROSS)
def transition_matrix(spark, sf_dir):
    return markov.transition_counts(_cells(spark, sf_dir), "init_lu", "curr_lu")


@query(f"SELECT \"from\", \"to\", round(n / sum(n) OVER (PARTITION BY \"from\"), 6) AS p FROM ({_CROSS})")
def transition_prob(spark, sf_dir):
    return markov.transition_probabilities(markov.transition_counts(_cells(spark, sf_dir), "init_lu", "curr_lu")).withColumn("p", F.round("p", 6))


@query(f"SELECT \"to\" AS class, round(sum(d.n * p.p), 4) AS n FROM (SELECT \"from\", \"to\", n / sum(n) OVER (PARTITION BY \"from\") AS p FROM ({_CROSS})) p JOIN (SELECT curr_lu AS class, count(*) AS n FROM g WHERE curr_lu > 0 GROUP BY 1) d ON \"from\" = class GROUP BY 1")
def markov_step(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    p = markov.transition_probabilities(markov.transition_counts(cells, "init_lu", "curr_lu"))
    now = cells.filter("curr_lu > 0").groupBy(F.col("curr_lu").cast("bigint").alias("class")).agg(F.count("*").alias("n"))
    return markov.step(now, p).withColumn("n", F.round("n", 4))


_LAST = ", ".join(f"{k}" for k in range(1, 7))
_MARKOV = f"""n1 AS (SELECT c.class, count(k) AS n FROM (SELECT unnest([{_LAST}]) AS class) c LEFT JOIN g ON curr_lu = c.class GROUP BY 1),
cr AS (SELECT init_lu AS f, curr_lu AS t, count(*) AS n FROM g WHERE init_lu > 0 AND curr_lu > 0 GROUP BY 1, 2),
pr AS (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS p FROM cr UNION ALL SELECT class, class, 1.0 FROM n1 WHERE class NOT IN (SELECT f FROM cr)),
s1 AS (SELECT t AS class, sum(n * p) AS n FROM n1 JOIN pr ON class = f GROUP BY 1),
s2 AS (SELECT t AS class, sum(n * p) AS n FROM s1 JOIN pr ON class = f GROUP BY 1),
s3 AS (SELECT t AS class, sum(n * p) AS n FROM s2 JOIN pr ON class = f GROUP BY 1)"""


@query(f", {_MARKOV} SELECT 2010 AS year, init_lu AS class, count(*) AS n FROM g WHERE init_lu > 0 GROUP BY 2 UNION ALL SELECT 2020, curr_lu, count(*) FROM g WHERE curr_lu > 0 GROUP BY 2 UNION ALL SELECT 2030, class, CAST(floor(n + 0.5) AS BIGINT) FROM s1 UNION ALL SELECT 2040, class, CAST(floor(n + 0.5) AS BIGINT) FROM s2 UNION ALL SELECT 2050, class, CAST(floor(n + 0.5) AS BIGINT) FROM s3")
def markov_predict(spark, sf_dir):
    return markov.predict(_periods(spark, sf_dir), 3)


@query("SELECT year AS \"Year\", " + ", ".join(f"count(*) FILTER (v = {k}) AS \"Type{k}\"" for k in range(1, 7)) + " FROM (SELECT 2010 AS year, init_lu AS v FROM g UNION ALL SELECT 2020, curr_lu FROM g) WHERE v > 0 GROUP BY 1")
def demand_wide(spark, sf_dir):
    return markov.wide(class_counts(spark, sf_dir))


@query("SELECT x, y, " + ", ".join(f"round((box_u{k} - u{k}) / 3.0 / (box_one - one), 6) AS share_{k}" for k in (1, 2, 5)) + " FROM (" + _box("u1 u2 u5 one", "2", "2", "SELECT x, y, " + ", ".join(f"CASE WHEN init_lu = {k} THEN 1 ELSE 0 END AS u{k}" for k in (1, 2, 5)) + ", 1 AS one FROM g") + ")")
def focal_share(spark, sf_dir):
    out = class_share(_cells(spark, sf_dir, v="init_lu"), "v", [1, 2, 5], 5)
    return _long(out.select("x", "y", *[_r(f"share_{k}") for k in (1, 2, 5)]), "x", "y")


@query("SELECT label, moved, least(count(*), CASE WHEN moved = 1 THEN 60 ELSE 80 END) AS n FROM (SELECT curr_lu AS label, CAST(init_lu <> curr_lu AS BIGINT) AS moved FROM g WHERE init_lu > 0 AND curr_lu > 0) GROUP BY 1, 2")
def stratified_cap_counts(spark, sf_dir):
    s = transition_ml.samples(_cells(spark, sf_dir, before="init_lu", after="curr_lu", d0="pop0", d1="pop1"), ["d0", "d1"], cap_changed=60, cap_same=80)
    return _long(s.groupBy("label", "moved").agg(F.count("*").alias("n")))


_COARSE = "SELECT cx AS x, cy AS y, {v} AS v FROM (SELECT unnest(range(w // 2)) AS cx, h, w FROM (SELECT w, (SELECT max(y) + 1 FROM g) AS h FROM s)), LATERAL (SELECT unnest(range(h // 2)) AS cy) t {join}"


@query(_COARSE.format(v="CAST(g.init_lu AS BIGINT)", join="LEFT JOIN g ON g.x = 2 * cx + 1 AND g.y = 2 * cy + 1"))
def resample_nearest(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    base = Grid(grid.width // 2, grid.height // 2, (0.0, 60.0, 0.0, 0.0, 0.0, -60.0), grid.crs)
    return _long(resample(Raster(cells.select("x", "y", F.col("init_lu").alias("v")), grid), base))


@query("SELECT cx AS x, cy AS y, round(avg(g.pop0), 4) AS v FROM (SELECT unnest(range(w // 2)) AS cx, h FROM (SELECT w, (SELECT max(y) + 1 FROM g) AS h FROM s)), LATERAL (SELECT unnest(range(h // 2)) AS cy) t LEFT JOIN g ON g.x // 2 = cx AND g.y // 2 = cy GROUP BY 1, 2")
def resample_bilinear(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    base = Grid(grid.width // 2, grid.height // 2, (0.0, 60.0, 0.0, 0.0, 0.0, -60.0), grid.crs)
    out = resample(Raster(cells.select("x", "y", F.col("pop0").alias("v")), grid), base, "bilinear")
    return _long(out, "x", "y").withColumn("v", F.round("v", 4))


@query("SELECT x // 4 AS x, y // 4 AS y, arg_min(init_lu, y * 100000 + x) FILTER (init_lu IS NOT NULL) AS v FROM g GROUP BY 1, 2")
def overview_nearest(spark, sf_dir):
    return _long(overview(_cells(spark, sf_dir, v="init_lu"), 4))


@query("SELECT x, y, CASE WHEN buf IS NULL THEN -1 ELSE init_lu END AS v FROM g")
def mask_by_nodata(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    return _long(mask_by(Raster(cells.select("x", "y", F.col("buf").alias("v")), grid), Raster(cells.select("x", "y", F.col("init_lu").alias("v")), grid), -1))


@query("SELECT x, y, init_lu, curr_lu, pop0 FROM g")
def align_stack(spark, sf_dir):
    cells, grid = order_grid(spark, sf_dir)
    return _long(align({c: Raster(cells.select("x", "y", F.col(c).alias("v")), grid) for c in ("init_lu", "curr_lu", "pop0")}), "x", "y", "init_lu", "curr_lu")


@query("SELECT x, y, CASE WHEN pop0 >= 200000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM g")
def rule_threshold(spark, sf_dir):
    return _long(_cells(spark, sf_dir).select("x", "y", rules.predicate("pop0", ">=", 200000).alias("v")), "x", "y")


@query("SELECT x, y, CASE WHEN pop0 >= (SELECT quantile_cont(pop0, 0.9) FROM g) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM g")
def rule_ranking(spark, sf_dir):
    return _long(rules.ranking(_cells(spark, sf_dir), "pop0", 10).select("x", "y", F.col("score").alias("v")), "x", "y")


@query("SELECT x, y, CASE WHEN (pop1 - pop0) / abs(pop0) > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM g")
def rule_change_rate(spark, sf_dir):
    return _long(_cells(spark, sf_dir).select("x", "y", rules.change_rate("pop0", "pop1", ">", 0.05).alias("v")), "x", "y")


@query("SELECT x, y, CASE WHEN box_m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (" + _box("m", "2", "2", "SELECT *, CASE WHEN init_lu = 5 AND buf IS NULL THEN 1 ELSE 0 END AS m FROM g") + ")")
def rule_spatial(spark, sf_dir):
    mask = priority.uncovered_class(_cells(spark, sf_dir), [5], "init_lu")
    return _long(rules.within(mask, 2).select("x", "y", F.col("score").alias("v")), "x", "y")


_PARTS = "CASE WHEN pop0 >= 200000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, CASE WHEN (pop1 - pop0) / abs(pop0) > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b"


def _declared(aggregation: str) -> list[dict]:
    return [
        {"id": "a", "type": "threshold", "weight": 0.7, "condition": {"indicator": "pop0", "operator": ">=", "value": 200000}},
        {"id": "all", "type": "composite", "aggregation": aggregation, "sub_rules": ["a", {"id": "b", "type": "change_rate", "weight": 0.3, "condition": {"before": "pop0", "after": "pop1", "operator": ">", "value": 0.05}}]},
    ]


def _composite(spark, sf_dir, aggregation):
    return _long(rules.evaluate(_cells(spark, sf_dir), _declared(aggregation)).select("x", "y", F.round("all", 6).alias("v")), "x", "y")


@query(f"SELECT x, y, round(0.7 * a + 0.3 * b, 6) AS v FROM (SELECT x, y, {_PARTS} FROM g)")
def composite_weighted_sum(spark, sf_dir):
    return _composite(spark, sf_dir, "weighted_sum")


@query(f"SELECT x, y, round(pow(a, 0.7) * pow(b, 0.3), 6) AS v FROM (SELECT x, y, {_PARTS} FROM g)")
def composite_geometric_mean(spark, sf_dir):
    return _composite(spark, sf_dir, "geometric_mean")


@query(f"SELECT x, y, least(a, b) AS v FROM (SELECT x, y, {_PARTS} FROM g)")
def composite_fuzzy_and(spark, sf_dir):
    return _composite(spark, sf_dir, "fuzzy_and")


@query(f"SELECT x, y, greatest(a, b) AS v FROM (SELECT x, y, {_PARTS} FROM g)")
def composite_fuzzy_or(spark, sf_dir):
    return _composite(spark, sf_dir, "fuzzy_or")


@query("SELECT x, y, 1 + " + " + ".join(f"CAST(pop0 >= q[{k}] AS BIGINT)" for k in (1, 2, 3)) + " AS class FROM g, (SELECT quantile_cont(pop0, [0.25, 0.5, 0.75]) AS q FROM g)")
def classify_quantile(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return _long(cells.select("x", "y", rules.classify("pop0", rules.breaks(cells, "pop0", "quantile", 4)).alias("class")))


@query("SELECT x, y, 1 + " + " + ".join(f"CAST(pop0 >= a + (b - a) * {k} / 5 AS BIGINT)" for k in (1, 2, 3, 4)) + " AS class FROM g, (SELECT min(pop0) a, max(pop0) b FROM g)")
def classify_equal_interval(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return _long(cells.select("x", "y", rules.classify("pop0", rules.breaks(cells, "pop0", "equal_interval", 5)).alias("class")))


@query()
def classify_natural_breaks(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return _long(cells.select("x", "y", rules.classify("pop0", rules.breaks(cells, "pop0", "natural_breaks", 5)).alias("class")))


def _scores(spark, sf_dir):
    """Scores per segment and nation as stand-ins for indicators per region."""
    c = table(spark, sf_dir, "customer")
    dim = F.element_at(F.array(F.lit("economy"), F.lit("society"), F.lit("environment")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_mktsegment").alias("region"), dim.alias("dimension"), F.col("c_acctbal").alias("score"))


_SCORES = "SELECT c_mktsegment AS region, ['economy', 'society', 'environment'][c_nationkey % 3 + 1] AS dimension, c_acctbal AS score FROM customer"


@query(f"SELECT dimension, round(avg(score), 6) AS score FROM ({_SCORES}) GROUP BY 1")
def dimension_scores(spark, sf_dir):
    return rules.dimension_scores(_scores(spark, sf_dir)).select("dimension", _r("score"))


@query(f"SELECT round(avg(s), 6) AS composite FROM (SELECT avg(score) AS s FROM ({_SCORES}) GROUP BY dimension)")
def composite_score(spark, sf_dir):
    return rules.composite_score(_scores(spark, sf_dir)).select(_r("composite"))


@query(f"SELECT CAST(place AS INTEGER) AS place, a.dimension, round(coalesce(avg(score), 0), 6) AS score FROM (VALUES (0, 'economy'), (1, 'society'), (2, 'environment')) a(place, dimension) LEFT JOIN ({_SCORES}) b ON a.dimension = b.dimension GROUP BY 1, 2")
def chart_radar(spark, sf_dir):
    return charts.radar(_scores(spark, sf_dir)).select("place", "dimension", _r("score"))


@query(f"SELECT p.region, a, round(x, 6) AS a_score, b, round(z, 6) AS b_score FROM (SELECT region, dimension AS a, avg(score) AS x FROM ({_SCORES}) GROUP BY 1, 2) p JOIN (SELECT region, dimension AS b, avg(score) AS z FROM ({_SCORES}) GROUP BY 1, 2) q ON p.region = q.region WHERE (a, b) IN (('economy', 'society'), ('economy', 'environment'), ('society', 'environment'))")
def chart_pairs(spark, sf_dir):
    return charts.pairs(_scores(spark, sf_dir)).select("region", "a", _r("a_score"), "b", _r("b_score"))


@query(f"SELECT region, score FROM ((SELECT CAST(c_custkey AS VARCHAR) AS region, c_acctbal AS score FROM customer ORDER BY score DESC, region LIMIT 10) UNION (SELECT CAST(c_custkey AS VARCHAR), c_acctbal AS score FROM customer ORDER BY score, 1 LIMIT 5))")
def chart_subregions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("region"), F.col("c_acctbal").alias("score"))
    return charts.subregions(rows)


@query("SELECT year, level, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share, round(sum(n) OVER (PARTITION BY year ORDER BY level) / sum(n) OVER (PARTITION BY year), 6) AS upto FROM (SELECT 2010 AS year, init_lu AS level, count(*) AS n FROM g WHERE init_lu > 0 GROUP BY 2 UNION ALL SELECT 2020, curr_lu, count(*) FROM g WHERE curr_lu > 0 GROUP BY 2)")
def chart_stacked_levels(spark, sf_dir):
    return charts.stacked_levels(class_counts(spark, sf_dir).withColumnRenamed("class", "level")).select("year", "level", "n", _r("share"), _r("upto"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END AS label FROM (SELECT event_id, (CASE WHEN event_type = 'purchase' THEN 0.7 ELSE 0.4 END) * ((event_id % 100) / 100.0) + 0.3 * ((user_id % 10) / 10.0) AS c FROM events)")
def confidence_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), ((F.col("event_id") % 100) / 100.0).alias("coverage"), ((F.col("user_id") % 10) / 10.0).alias("freshness"))
    return rules.confidence(e, {"coverage": 0.4, "freshness": 0.3}, {"purchase": {"coverage": 0.7}}).select("event_id", _r("confidence"), "label")


@query("SELECT c_mktsegment AS region, round(avg(CAST(c_acctbal < 0 AS DOUBLE)), 6) AS share, CASE WHEN avg(CAST(c_acctbal < 0 AS DOUBLE)) < 0.2 THEN 'low' WHEN avg(CAST(c_acctbal < 0 AS DOUBLE)) < 0.4 THEN 'moderate' WHEN avg(CAST(c_acctbal < 0 AS DOUBLE)) < 0.6 THEN 'high' ELSE 'critical' END AS grade FROM customer GROUP BY 1")
def priority_grade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("region"), (F.col("c_acctbal") < 0).alias("hit"))
    return rules.grade(c, "region", "hit").select("region", _r("share"), "grade")


@query("SELECT tool, CASE max(CASE WHEN (tool = 'view' AND value > 90) OR value > 1000 OR value < 0 THEN 3 WHEN tool = 'click' AND value > 50 AND value < 60 THEN 2 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' ELSE 'PASS' END AS overall FROM (SELECT event_type AS tool, value FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1")
def validation_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), "value")
    spec = [
        {"tool": "view", "metric": "value", "valid_range": {"min": 0, "max": 1000}, "anomaly_patterns": [{"id": "high", "condition": "value > 90", "severity": "fail"}]},
        {"tool": "click", "metric": "value", "valid_range": {"min": 0, "max": 1000}, "anomaly_patterns": [{"id": "odd", "condition": "value > 50 AND value < 60", "severity": "warn"}]},
    ]
    return rules.roll_up(rules.validate(e, spec))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 'first' WHEN contains(lower(coalesce(text, '')), 'de') THEN 'second' ELSE 'unknown' END AS intent FROM conversations")
def intent_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rules.route(rows, [{"name": "second", "priority": 2, "keywords": ["de"]}, {"name": "first", "priority": 1, "keywords": ["the"]}]).select("conv_id", "turn", "intent")


@query("SELECT doc_id, CAST(floor(1.5 * len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) + len(regexp_extract_all(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]', ' ', 'g'), '\\S+'))) AS INTEGER) AS tokens FROM documents")
def kb_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", knowledge.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT source, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY 1")
def kb_source_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return knowledge.stats(d.withColumn("token_count", knowledge.token_estimate(F.col("text"))))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return knowledge.top_k(e, q, 10).select("vec_id", _r("score"))


@query("SELECT doc_id, len(list_intersect(['the', 'de', 'la'], regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) / 3.0 AS score FROM documents")
def keyword_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", knowledge.keyword_score(F.col("text"), "the de la").alias("score"))


@query()
def chunk_headings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("# "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.col("text")).alias("text"))
    return knowledge.chunk(d)


@query("SELECT coalesce(f.path, n.path) AS path, coalesce(f.region, n.region) AS region, CAST(coalesce(f.c, 0) + coalesce(n.c, 0) AS INTEGER) AS count FROM (SELECT 'f' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'r' || s_nationkey END AS region, 1 AS c FROM supplier) f FULL JOIN (SELECT path, max(region) AS region, count(*) AS c FROM (SELECT 'f' || (s_suppkey + 5) AS path, 'n' || s_nationkey AS region FROM supplier) GROUP BY 1) n ON f.path = n.path")
def registry_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    none = F.lit(None)
    old = s.select(F.concat(F.lit("f"), "s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("r"), "s_nationkey")).alias("region"), none.cast("string").alias("category"), none.cast("int").alias("year"), F.lit(1).alias("count"), none.cast("string").alias("updated"))
    new = s.select(F.concat(F.lit("f"), F.col("s_suppkey") + 5).alias("path"), F.concat(F.lit("n"), "s_nationkey").alias("region"), none.cast("string").alias("category"), none.cast("int").alias("year"), none.cast("string").alias("updated"))
    return registry.upsert(old, new).select("path", "region", "count")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, 'orphan' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION SELECT CAST(l_orderkey AS VARCHAR), 'missing' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphan_antijoin(spark, sf_dir):
    disk = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"))
    return manifest.orphans(listed, disk)


@query("SELECT CAST(c_mktsegment AS VARCHAR) AS dataset, list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))) AS crs FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def crs_conflicts(spark, sf_dir):
    return manifest.crs_conflicts(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").cast("string").alias("crs")))


@query("SELECT conv_id AS session_id, arg_max(text, turn) FILTER (text IS NOT NULL) AS summary, count(*) AS n FROM conversations GROUP BY 1")
def session_state(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.col("text").alias("summary"))
    n = c.groupBy("session_id").agg(F.count("*").alias("n"))
    return registry.current(c).join(n, "session_id")


@query("SELECT p_partkey AS id, CAST((CAST(floor(p_retailprice) AS BIGINT) - 9999) % 256 + CASE WHEN (CAST(floor(p_retailprice) AS BIGINT) - 9999) % 256 < 0 THEN 256 ELSE 0 END AS BIGINT) AS v FROM part")
def byte_wrap(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), wrap(F.floor("p_retailprice") - 9999, "Byte").cast("bigint").alias("v"))


# Registry, manifest, report and parameter operators on the given tables.

_NAMES = "(SELECT p_partkey AS id, ['lucc', 'POP density', '人口', 'carbon_sink', 'dem', 'dist-road', 'misc', 'npp viirs'][1 + p_partkey % 8] || ['_', '-', ' '][1 + p_partkey % 3] || (1895 + p_partkey % 260) || ['_ssp1', '-SSP2-45', '_ssp585', '_baseline', ''][1 + p_partkey % 5] || '.tif' AS name FROM part)"


def _names(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    name = F.concat(
        pick(8, "lucc", "POP density", "人口", "carbon_sink", "dem", "dist-road", "misc", "npp viirs"), pick(3, "_", "-", " "), (1895 + k % 260).cast("string"), pick(5, "_ssp1", "-SSP2-45", "_ssp585", "_baseline", ""), F.lit(".tif")
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"))


@query(f"SELECT id, CASE WHEN try_cast(y AS INTEGER) BETWEEN 1900 AND 2100 THEN CAST(y AS INTEGER) END AS year FROM (SELECT id, regexp_extract(name, '(?:^|[_\\-\\s])([0-9]{{4}})(?:[_\\-\\s.]|$)', 1) AS y FROM {_NAMES})")
def file_year(spark, sf_dir):
    return _names(spark, sf_dir).select("id", manifest.file_year(F.col("name")).alias("year"))


@query(f"SELECT id, CASE " + " ".join(f"WHEN contains(translate(lower(name), '- ', '__'), '{m}') THEN '{v}'" for v, m in manifest.SCENARIOS) + f" END AS scenario FROM {_NAMES}")
def file_scenario(spark, sf_dir):
    return _names(spark, sf_dir).select("id", manifest.file_scenario(F.col("name")).alias("scenario"))


def _category_sql() -> str:
    found = [
        f"{{'n': " + " + ".join(f"CASE WHEN contains({'low' if w.isascii() else 'name'}, '{w}') THEN {len(w) * (1 if w.isascii() else 2)} ELSE 0 END" for w in words) + f", 'k': {-k}, 'c': '{c}'}}"
        for k, (c, words) in enumerate(manifest.CATEGORIES.items())
    ]
    return f"SELECT id, name, CASE WHEN b.n > 0 THEN b.c ELSE 'unknown' END AS category FROM (SELECT id, name, list_max([{', '.join(found)}]) AS b FROM (SELECT id, name, translate(lower(name), '- ', '__') AS low FROM {_NAMES}))"


@query(f"SELECT id, category FROM ({_category_sql()})")
def file_category(spark, sf_dir):
    return _names(spark, sf_dir).select("id", manifest.file_category(F.col("name")).alias("category"))


@query(f"SELECT category AS id, count(*) AS n_files FROM ({_category_sql()}) GROUP BY 1")
def manifest_build(spark, sf_dir):
    files = _names(spark, sf_dir).select(F.col("name").alias("path"), F.lit(None).cast("double").alias("res"))
    built = manifest.build(files, "p")["datasets"]
    return spark.createDataFrame([(d["id"], len(d["files"])) for d in built], "id string, n_files bigint")


@query("SELECT CAST(id AS BIGINT) AS id, problem FROM (SELECT p_partkey AS id, unnest([CASE WHEN 1800 + p_size * 10 > 2100 OR p_size < 10 THEN 'year_out_of_range' END, CASE WHEN p_brand <> 'Brand#1' AND p_size % 2 = 0 THEN 'scenario_not_declared' END, CASE WHEN p_size % 7 = 0 THEN 'unknown_dataset' END]) AS problem FROM part) WHERE problem IS NOT NULL")
def manifest_integrity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(
        F.col("p_partkey").cast("string").alias("path"),
        (1800 + F.col("p_size") * 10).cast("int").alias("year"),
        F.when((F.col("p_size") % 2 == 0) & (F.col("p_brand") != "Brand#1"), "other").otherwise("declared").alias("scenario"),
        F.when(F.col("p_size") % 7 == 0, "nowhere").otherwise("d").alias("dataset"),
    )
    return manifest.integrity(files, ["declared"], ["d"]).select(F.col("path").cast("bigint").alias("id"), "problem")


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS scenario, CAST(o_orderkey AS VARCHAR) AS indicator FROM orders")
def manifest_legacy(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    paths = o.select(F.concat(F.lit("/data/"), F.year("o_orderdate"), F.lit("/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"))
    return manifest.legacy(paths).select("year", "scenario", "indicator")


@query("SELECT s_suppkey AS id, 's/' || s_suppkey || '.tif' AS path FROM supplier")
def manifest_relative(spark, sf_dir):
    full = F.concat(F.lit("/data/v1.0/s/"), F.col("s_suppkey").cast("string"), F.lit(".tif"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), manifest.relative(full, "/data/v1.0/").alias("path"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand AS region, p_type AS category, CAST(p_size AS INTEGER) AS year FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size = 7")
def registry_listed(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("region"), F.col("p_type").alias("category"), F.col("p_size").cast("int").alias("year"))
    return registry.listed(files, region=p.agg(F.min("p_brand")).first()[0], year=7)


@query("SELECT CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def registry_stale(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("path"))
    return registry.stale(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path")), have)


@query("SELECT o_orderkey AS report_id, o_orderstatus AS region, CAST(o_orderdate AS VARCHAR) AS created FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def registry_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderstatus").alias("region"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created"))
    return registry.reports(rows, region="F").select("report_id", "region", F.col("created").cast("string").alias("created"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS session_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10")
def registry_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderdate").cast("string").alias("started"))
    return registry.latest(rows).select("session_id")


@query("SELECT o_orderkey AS session_id, v.vec_id IS NOT NULL AS has_vector FROM orders LEFT JOIN embeddings v ON v.vec_id = o_orderkey WHERE o_orderstatus = 'F'")
def registry_archive(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("status"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session_id"), "embedding")
    return registry.archive(s, v).select("session_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("SELECT coalesce(n_name, name) AS name, CASE WHEN n_name IS NOT NULL AND n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE fallback END AS value FROM nation FULL JOIN (VALUES ('FRANCE', 'x'), ('unit', 'km2')) d(name, fallback) ON n_name = name")
def registry_preferences(spark, sf_dir):
    saved = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("value"))
    return registry.preferences(saved, {"FRANCE": "x", "unit": "km2"})


@query("SELECT c_mktsegment AS indicator, round(avg(c_acctbal), 4) AS score FROM customer GROUP BY 1")
def chart_bars(spark, sf_dir):
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("indicator")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"))
    return charts.bars(scores)


@query("SELECT DISTINCT o_custkey AS chart_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def chart_missing(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chart_id")).distinct()
    return charts.missing_charts(wanted, table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("chart_id")))


@query("SELECT year(o_orderdate) AS year, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS economy, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS society FROM orders GROUP BY 1")
def chart_trend(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "economy").when(F.col("o_orderstatus") == "O", "society").otherwise("environment")
    scores = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), status.alias("dimension"), F.col("o_totalprice").alias("score"))
    return charts.trend(scores).select("year", _r("economy", 2), _r("society", 2))


@query("SELECT symptom, cause, confidence, rank FROM (SELECT p_type AS symptom, p_name AS cause, p_retailprice AS confidence, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_name) AS rank FROM part) WHERE rank <= 3")
def diagnose(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.groupBy(F.col("p_type").alias("symptom")).agg(F.collect_list(F.struct(F.col("p_name").alias("cause"), F.col("p_retailprice").alias("confidence"))).alias("causes"))
    return rules.diagnose(p.select(F.col("p_type").alias("symptom")).distinct(), known).select("symptom", "cause", "confidence", F.col("rank").cast("bigint").alias("rank"))


_WORDS3 = "len(list_intersect(['der', 'elle', 'migaja'], regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) / 3.0"


@query(f"SELECT doc_id, round(s, 6) AS score, 'keyword' AS via FROM (SELECT doc_id, {_WORDS3} AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 5")
def keyword_search(spark, sf_dir):
    return knowledge.search(table(spark, sf_dir, "documents"), "der elle migaja").select("doc_id", _r("score"), "via")


_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))"


@query(
    f"WITH w AS (SELECT doc_id, s AS score, 'keyword' AS via FROM (SELECT doc_id, {_WORDS3} AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 5), "
    f"v AS (SELECT vec_id AS doc_id, c AS score, 'vector' AS via FROM (SELECT vec_id, {_COS} AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 10) "
    "SELECT doc_id, round(score, 6) AS score, via FROM (SELECT * FROM w UNION ALL SELECT * FROM v WHERE doc_id NOT IN (SELECT doc_id FROM w)) ORDER BY score DESC, doc_id LIMIT 5"
)
def hybrid_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id = 3").first()["embedding"]
    return knowledge.search(table(spark, sf_dir, "documents"), "der elle migaja", e, q).select("doc_id", _r("score"), "via")


@query("SELECT string_agg('[' || source || '] (' || printf('%.4f', score) || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY score DESC, source) AS context FROM (SELECT 's' || s_suppkey AS source, s_acctbal AS score, s_name AS t FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)")
def search_context(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(5)
    return knowledge.context(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("text")))


_REPORT = """r AS (SELECT d.doc_id AS id, CASE d.doc_id % 4 WHEN 0 THEN 'composite' WHEN 1 THEN 'trend' WHEN 2 THEN 'subregion' END AS template,
  d.text || CASE WHEN d.doc_id % 3 = 0 THEN ' 执行摘要 指标总览 结论' ELSE '' END || CASE WHEN d.doc_id % 11 = 0 THEN '{{ x }}' ELSE '' END || CASE WHEN d.doc_id % 5 = 0 THEN 'NoData' ELSE '' END
   || CASE WHEN d.doc_id % 18 = 0 THEN 'chart' ELSE '' END AS content, CASE WHEN d.doc_id % 7 <> 0 THEN source END AS title FROM documents d WHERE text IS NOT NULL),
i AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE CAST(doc_id % 130 AS VARCHAR) END AS value, doc_id % 2 = 0 AS scored, doc_id % 6 = 0 AS bare, toxic = 1 AS nodata FROM labels),
j AS (SELECT r.*, i.id IS NOT NULL AS has, coalesce(value = 'x' OR (scored AND CAST(r.id % 130 AS INT) > 100), false) AS wrong, coalesce(bare, false) AS bare, coalesce(nodata, false) AS nodata,
  r.id % 9 = 0 AS charted, r.id % 36 <> 0 AND r.id % 9 = 0 AS lost FROM r LEFT JOIN i ON r.id = i.id)"""


def _reported(spark, sf_dir) -> DataFrame:
    d, k = table(spark, sf_dir, "documents").filter("text is not null"), F.col("doc_id")
    mark = lambda n, text: F.when(k % n == 0, text).otherwise("")
    content = F.concat("text", mark(3, " 执行摘要 指标总览 结论"), mark(11, "{{ x }}"), mark(5, "NoData"), mark(18, "chart"))
    rep = d.select(k.alias("report_id"), F.when(k % 4 == 0, "composite").when(k % 4 == 1, "trend").when(k % 4 == 2, "subregion").alias("template"), content.alias("content"), F.when(k % 7 != 0, F.col("source")).alias("title"), F.lit("p").alias("period"))
    ind = table(spark, sf_dir, "labels").select(
        k.alias("report_id"), F.when(k % 2 == 0, "score").otherwise("c").alias("code"), F.lit("n").alias("name"), F.when(k % 13 == 0, "x").otherwise((k % 130).cast("string")).alias("value"), F.when(k % 6 != 0, "%").alias("unit"), (F.col("toxic") == 1).alias("nodata_handled")
    )
    cha = d.filter(k % 9 == 0).select(k.alias("report_id"), F.lit("chart").alias("chart_id"), F.concat(F.lit("f/"), k.cast("string"), F.lit(".png")).alias("path"))
    files = d.filter(k % 36 == 0).select(F.concat(F.lit("f/"), k.cast("string"), F.lit(".png")).alias("path"))
    return reports.checks(rep, ind, cha, files)


_RULES = """SELECT id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS rule_id, unnest([CASE WHEN coalesce(title, '') = '' THEN 'FAIL' ELSE 'PASS' END, CASE WHEN NOT has OR wrong THEN 'WARN' ELSE 'PASS' END, CASE WHEN lost THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN (template = 'composite' AND id % 3 <> 0) OR template IN ('trend', 'subregion') THEN 'FAIL' ELSE 'PASS' END, CASE WHEN charted AND NOT contains(content, 'chart') AND NOT contains(content, id || '.png') THEN 'WARN' ELSE 'PASS' END,
  CASE WHEN bare THEN 'WARN' ELSE 'PASS' END, CASE WHEN nodata AND NOT contains(lower(content), 'nodata') THEN 'WARN' ELSE 'PASS' END, CASE WHEN regexp_matches(content, '\\{\\{.*\\}\\}') THEN 'FAIL' ELSE 'PASS' END, CASE WHEN trim(content) = '' THEN 'FAIL' ELSE 'PASS' END]) AS severity FROM j"""


@query(f"WITH {_REPORT} SELECT id AS report_id, rule_id, severity FROM ({_RULES})")
def report_checks(spark, sf_dir):
    return _reported(spark, sf_dir)


@query(f"WITH {_REPORT} SELECT id AS report_id, CASE WHEN bool_or(severity = 'FAIL') THEN 'FAIL' WHEN bool_or(severity = 'WARN') THEN 'WARN' ELSE 'PASS' END AS overall FROM ({_RULES}) GROUP BY 1")
def report_verdicts(spark, sf_dir):
    return reports.verdicts(_reported(spark, sf_dir))


def _rows(*rows: tuple[str, str]):
    """A query over parsed parameters: (input, its reading as text) against the values as they should be."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") t(text, reading)"


def _read(spark, parser, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t, str(parser(t)).replace("'", "")) for t in texts], "text string, reading string")


@query(_rows(("1,2;3", "[1, 2, 3]"), ("", "[]"), (" 7 ,,8", "[7, 8]")))
def parse_integers(spark, sf_dir):
    return _read(spark, parse.integers, "1,2;3", "", " 7 ,,8")


@query(_rows(("1.5;2", "[1.5, 2.0]"), ("-3", "[-3.0]")))
def parse_numbers(spark, sf_dir):
    return _read(spark, parse.numbers, "1.5;2", "-3")


@query(_rows(("2:5:6,4:5", "{2: [5, 6], 4: [5]}"), ("2>5,2>6,4>5", "{2: [5, 6], 4: [5]}"), ("", "{}")))
def parse_transitions(spark, sf_dir):
    return _read(spark, parse.transitions, "2:5:6,4:5", "2>5,2>6,4>5", "")


@query(_rows(("1:-1,2:-20.5", "{1: -1.0, 2: -20.5}")))
def parse_factors(spark, sf_dir):
    return _read(spark, parse.factors, "1:-1,2:-20.5")


@query(_rows(("1:2,3:4", "{1: 2, 3: 4}")))
def parse_remap(spark, sf_dir):
    return _read(spark, parse.remap, "1:2,3:4")


@query(_rows(("a.tif; b.tif", "[a.tif, b.tif]")))
def parse_paths(spark, sf_dir):
    return _read(spark, parse.paths, "a.tif; b.tif")


@query(_rows(("TRUE", "True"), ("yes", "True"), ("0", "False")))
def parse_boolean(spark, sf_dir):
    return _read(spark, parse.boolean, "TRUE", "yes", "0")


@query(_rows(("v1.2", "(1, 2, 0)"), ("3.4.5-b6", "(3, 4, 5)")))
def parse_version(spark, sf_dir):
    return _read(spark, parse.version, "v1.2", "3.4.5-b6")


@query(_rows(("a/b.tif", "a/b_resampled.tif"), ("c", "c_resampled")))
def output_names(spark, sf_dir):
    return _read(spark, parse.output_name, "a/b.tif", "c")


@query(_rows(("AUTHORITY[\"EPSG\",\"9001\"] AUTHORITY[\"EPSG\",\"4326\"]", "EPSG:4326"), ("LOCAL_CS[\"arbitrary plane\"]", "LOCAL_CS[\"arbitrary ")))
def parse_epsg(spark, sf_dir):
    return _read(spark, parse.epsg, 'AUTHORITY["EPSG","9001"] AUTHORITY["EPSG","4326"]', 'LOCAL_CS["arbitrary plane"]')


@query(_rows(("512", "512.00 B"), ("1536", "1.50 KB"), ("3221225472", "3.00 GB")))
def readable_sizes(spark, sf_dir):
    return _read(spark, lambda t: parse.readable_size(float(t)), "512", "1536", "3221225472")


@query(f"SELECT x, y, {_R3} AS v FROM g")
def priority_uncovered_class(spark, sf_dir):
    return _mask(priority.uncovered(_cells(spark, sf_dir), "init_lu", classes=[5]))


@query(f"SELECT x, y, {_R4} AS v FROM g")
def priority_uncovered_population(spark, sf_dir):
    return _mask(priority.uncovered(_cells(spark, sf_dir), "pop0", threshold=250000))


@query("SELECT x, y, CAST(init_lu AS DOUBLE) AS v FROM g")
def geotiff_round_trip(spark, sf_dir):
    """Cells dealt by hash, written as strips of a raster in the shared folder and read back."""
    cells, grid = order_grid(spark, sf_dir)
    path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}.tif"
    write_geotiff(cells.select("x", "y", F.col("init_lu").alias("v")).repartition(7, "x", "y"), path, replace(grid, nodata=-9999.0, dtype="Int32"))
    back = spark.read.format("geotiff").load(path)
    return back.join(cells.select(F.col("x").alias("cx"), F.col("y").alias("cy")), (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))).select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "v")


@query("SELECT x, y, round(pop0, 2) AS b1, CAST(curr_lu AS DOUBLE) AS b2 FROM g")
def geotiff_bands(spark, sf_dir):
    """Two bands of 64-bit numbers through the sink and back."""
    cells, grid = order_grid(spark, sf_dir)
    path = f"{shared_folder(spark)}/bands-{uuid.uuid4().hex}.tif"
    two = cells.select("x", "y", F.array(F.col("pop0").cast("double"), F.col("curr_lu").cast("double")).alias("bands"))
    write_geotiff(two.repartition(5, "y", "x"), path, replace(grid, nodata=-9999.0, dtype="Float64", bands=2))
    back = spark.read.format("geotiff").option("bands", "all").load(path)
    back = back.join(cells.select(F.col("x").alias("cx"), F.col("y").alias("cy")), (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")))
    return back.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.round(F.col("bands")[0], 2).alias("b1"), F.col("bands")[1].alias("b2"))


@query(
    """, p AS (SELECT count(*) FILTER (init_lu = 1) / count(init_lu) AS a, count(*) FILTER (init_lu = 4) / count(init_lu) AS b, count(*) FILTER (init_lu = 2) / count(init_lu) AS c,
      count(*) FILTER (init_lu = 2 AND curr_lu <> 2) / count(*) FILTER (init_lu = 2) AS d FROM g)
    SELECT number, target, command, round(value, 9) AS value,
      CASE WHEN low IS NOT NULL THEN round(greatest(0, least(100, CASE WHEN number = 27 THEN (high - value) / (high - low) ELSE (value - low) / (high - low) END * 100)), 6) END AS score FROM (
      SELECT 1 AS number, '2.1.2' AS target, 'sdg-land-proportion' AS command, a AS value, 0.1 AS low, 0.8 AS high FROM p
      UNION ALL SELECT 14, '6.6.1', 'sdg-land-proportion', b, 0.05, 0.3 FROM p UNION ALL SELECT 25, '15.1.1', 'sdg-land-proportion', c, 0.05, 0.5 FROM p
      UNION ALL SELECT 27, '15.3.1', 'sdg-land-conversion', d, 0.0, 0.5 FROM p UNION ALL SELECT 26, '15.2.1', 'sdg-land-conversion', d, NULL, NULL FROM p)"""
)
def indicator_catalogue(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    lu, all_cells = F.col("init_lu"), F.count("init_lu")
    lost = n((lu == 2) & (F.col("curr_lu") != 2)) / n(lu == 2)
    row = _cells(spark, sf_dir, init_lu="init_lu", curr_lu="curr_lu").agg(F.map_from_arrays(F.array(*[F.lit(k) for k in (1, 14, 25, 26, 27)]), F.array(n(lu == 1) / all_cells, n(lu == 4) / all_cells, n(lu == 2) / all_cells, lost, lost)).alias("m"))
    out = catalogue.scored(row.select(F.explode("m").alias("number", "value")))
    return out.select("number", "target", "command", F.round("value", 9).alias("value"), F.round("score", 6).alias("score"))


def _drivers(spark, sf_dir):
    cells = _cells(spark, sf_dir, before="init_lu", after="curr_lu", d0="pop0")
    return cells.withColumn("d1", (F.col("x") % 7).cast("double"))


def _learned(spark, sf_dir, method):
    cells, names = _drivers(spark, sf_dir), ["d0", "d1"]
    model, classes = transition_ml.train(transition_ml.samples(cells, names), names, method)
    return transition_ml.score(cells, model, names, classes).select("x", "y", F.transform("pg", lambda p: F.round(p, 6)).alias("pg"))


@query()
def pg_random_forest(spark, sf_dir):
    return _learned(spark, sf_dir, "rf")


@query()
def pg_logit(spark, sf_dir):
    return _learned(spark, sf_dir, "logit")


@query()
def pg_mlp(spark, sf_dir):
    return _learned(spark, sf_dir, "ann")


def _checkpoints(spark):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@query()
def ca_simulate(spark, sf_dir):
    _checkpoints(spark)
    cells = _cells(spark, sf_dir, v="init_lu", redline="buf")
    classes = [1, 2, 3, 4, 5, 6]
    pg = F.array(*[F.when(F.col("v").isNotNull(), 0.1 + 0.15 * ((F.col("x") + F.col("y") + k) % 6)).otherwise(0.0) for k in classes])
    counts = {r["v"]: r["n"] for r in cells.groupBy("v").agg(F.count("*").alias("n")).collect() if r["v"]}  # a row a class
    moved = max(1, sum(counts.values()) // 50)
    wanted = {**counts, 5: counts.get(5, 0) + moved, 1: counts.get(1, 0) - moved}
    out, _ = automata.simulate(cells.withColumn("pg", pg), wanted, classes, {1: [5]}, iterations=3)
    return out.select("x", "y", "v")


@query()
def infra_simulate(spark, sf_dir):
    _checkpoints(spark)
    cells = _cells(spark, sf_dir).select("x", "y", F.when(F.col("init_lu") == 5, 1).otherwise(0).alias("v"), ((F.col("x") % 10) / 10.0).alias("zone"))
    have = cells.agg(F.sum("v")).first()[0]
    return infrastructure.simulate(cells, have + 50, iterations=3, compat=False)[0]
