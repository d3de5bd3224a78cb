"""Named commands over cell tables: the engine's surface for scripts and pipelines.

Every command takes a session and keyword parameters (strings in command syntax or Python values) and returns a frame.
Rasters are paths of cell tables (Parquet) or of GeoTIFFs. Defaults are one canonical set.
"""

from __future__ import annotations

import inspect as _inspect
import json
import warnings
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import parse
from ..grid import Grid, GridError, Raster
from ..operators import accuracy, automata, catalogue, indicators, infrastructure, inspection, markov, preprocess, priority, transition_ml
from ..operators.align import align, resample as regrid
from ..sources.geotiff import GeoTiffSource, grid_of, write_geotiff
from ..sources.grids import load_grid, save_grid
from ..sources.tables import literal_samples, read_binary_demand, read_demand, read_reclass, write_demand
from . import dag, plugins

COMMANDS: dict[str, Callable] = {}


def command(name: str) -> Callable:
    def register(f: Callable) -> Callable:
        COMMANDS[name] = f
        return f

    return register


def raster(spark: SparkSession, path: str | Raster) -> Raster:
    """A raster by its path; a Parquet table has its grid beside it (tables of other origin count as a unit grid)."""
    if isinstance(path, Raster):
        return path
    if path.lower().endswith((".tif", ".tiff")):
        spark.dataSource.register(GeoTiffSource)
        return Raster(spark.read.format("geotiff").load(path), grid_of(path))
    cells = spark.read.parquet(path)
    kept = load_grid(spark, path)
    if kept is None:
        ends = cells.agg(F.max("x"), F.max("y")).first()
        kept = Grid((ends[0] or 0) + 1, (ends[1] or 0) + 1)
        warnings.warn(f"{path} has no grid beside it: cells count as units without a projection", stacklevel=2)
    return Raster(cells, kept)


def _cells(spark, **paths) -> DataFrame:
    return align({k: raster(spark, v) for k, v in paths.items()})


def _ints(x) -> list[int]:
    return parse.integers(x) if isinstance(x, str) else list(x)


def _moves(x) -> dict[int, list[int]]:
    return parse.transitions(x) if isinstance(x, str) else dict(x)


def _factors(x) -> dict[int, float]:
    return parse.factors(x) if isinstance(x, str) else dict(x)


def _grid(spark: SparkSession, path: str | Raster, output: str | None) -> Grid | None:
    """The grid of an input, where there is an output that takes it over; without a projection its origin is put right."""
    return raster(spark, path).grid.fixed() if output else None


def _out(df: DataFrame, output: str | None, grid: Grid | None = None) -> DataFrame:
    """Write a raster as GeoTIFF (a path that ends so) or as a Parquet table with its grid beside it, and read it back.

    An array column is written as bands of Float32, whole numbers as Int32, others as Float32; NoData is -9999.
    """
    if not output:
        return df
    spark = df.sparkSession
    value = next((c for c in ("v", "level", "pg", "bands") if c in df.columns), df.columns[-1])
    kind = df.schema[value].dataType.simpleString()
    if output.lower().endswith((".tif", ".tiff")):
        if grid is None:
            raise GridError("a raster output needs a grid")
        k = (df.select(F.max(F.size(value))).first()[0] or 1) if kind.startswith("array") else 1
        own = replace(grid, bands=int(k), nodata=-9999.0, dtype="Int32" if kind in ("tinyint", "smallint", "int", "bigint") else "Float32")
        write_geotiff(df.select("x", "y", F.col(value).alias("bands" if kind.startswith("array") else "v")), output, own)
        return spark.read.format("geotiff").option("bands", "all" if kind.startswith("array") else "1").load(output)
    df.write.mode("overwrite").parquet(output)
    if grid is not None:
        save_grid(spark, output, grid)
    return spark.read.parquet(output)


@command("sdg-land-proportion")
def land_proportion(spark, lucc, types, max=100.0, min=0.0):
    return indicators.land_proportion(raster(spark, lucc).cells, _ints(types), low=float(min), high=float(max))


@command("sdg-land-conversion")
def land_conversion(spark, init_lucc, curr_lucc, transitions, max=100.0, min=0.0, positive=True, compat=True):
    return indicators.land_conversion(_cells(spark, before=init_lucc, after=curr_lucc), _moves(transitions), low=float(min), high=float(max), positive=positive, compat=compat)


@command("sdg-buffer-zone")
def buffer_zone(spark, data, buffer, types="", max=100.0, min=0.0):
    cells = _cells(spark, v=data, buf=buffer)
    if types and raster(spark, data).grid.dtype == "Byte":
        return indicators.coverage_class(cells, _ints(types), low=float(min), high=float(max))
    return indicators.coverage_population(cells, low=float(min), high=float(max))


@command("sdg-1131")
def growth(spark, pre_lucc, now_lucc, pre_popu, now_popu, types, max=100.0, min=0.0, best=1.12):
    cells = _cells(spark, l0=pre_lucc, l1=now_lucc, p0=pre_popu, p1=now_popu)
    return indicators.growth_ratio(cells, _ints(types), ("l0", "l1"), ("p0", "p1"), float(min), float(max), float(best))


@command("sdg-1322")
def emission(spark, init_lucc, curr_lucc, emission, ratio=0.012):
    return indicators.emission_change(_cells(spark, before=init_lucc, after=curr_lucc), _factors(emission), float(ratio))


@command("ca-precision")
def precision(spark, original, simulated, real):
    cells = _cells(spark, original=original, simulated=simulated, real=real)
    return accuracy.change_accuracy(cells).join(accuracy.map_agreement(cells))  # one row each


@command("correlation")
def correlation(spark, data1, data2):
    return accuracy.pearson(literal_samples(spark, data1, data2))


@command("t-test")
def t_test(spark, data1, data2):
    a, b = parse.numbers(data1), parse.numbers(data2)
    n = max(len(a), len(b))
    rows = [(a[k] if k < len(a) else None, b[k] if k < len(b) else None) for k in range(n)]
    return accuracy.welch_t(spark.createDataFrame(rows, "a double, b double"))


@command("priority-loss")
def priority_loss(spark, init_lucc, curr_lucc, types, output=None):
    return _out(priority.loss(_cells(spark, before=init_lucc, after=curr_lucc), _ints(types)), output, _grid(spark, init_lucc, output))


@command("priority-transition")
def priority_transition(spark, init_lucc, curr_lucc, transitions, output=None):
    return _out(priority.converted(_cells(spark, before=init_lucc, after=curr_lucc), _moves(transitions)), output, _grid(spark, init_lucc, output))


@command("priority-buffer")
def priority_buffer(spark, data, buffer, types="", pop_threshold=1000.0, output=None):
    return _out(priority.uncovered(_cells(spark, v=data, buf=buffer), classes=_ints(types) if types else (), threshold=float(pop_threshold)), output, _grid(spark, data, output))


@command("priority-emission")
def priority_emission(spark, init_lucc, curr_lucc, emission, radius=3, output=None):
    return _out(priority.emission_growth(_cells(spark, before=init_lucc, after=curr_lucc), _factors(emission), int(radius)), output, _grid(spark, init_lucc, output))


@command("priority-human-land")
def priority_human_land(spark, pre_lucc, now_lucc, pre_popu, now_popu, types, radius=3, output=None):
    return _out(priority.people_and_land(_cells(spark, land0=pre_lucc, land1=now_lucc, pop0=pre_popu, pop1=now_popu), _ints(types), int(radius)), output, _grid(spark, pre_lucc, output))


@command("priority-merge")
def priority_merge(spark, inputs, output=None):
    found = parse.paths(inputs) if isinstance(inputs, str) else inputs
    return _out(priority.merge([raster(spark, p).cells for p in found]), output, _grid(spark, found[0], output))


@command("priority-stats")
def priority_stats(spark, input, compat=True):
    r = raster(spark, input)
    cells = r.cells if "level" in r.cells.columns else r.cells.withColumnRenamed("v", "level")
    return priority.level_stats(cells, r.grid, compat)


@command("check")
def check(spark, file, ref=None, types=None, deep=True):
    r = raster(spark, file)
    return inspection.inspect(r.cells, r.grid, raster(spark, ref).grid if ref else None, _ints(types) if types else None, deep=deep)


@command("resample")
def resample(spark, inputs, base, method="nearest", output=None):
    grid = raster(spark, base).grid
    found = parse.paths(inputs) if isinstance(inputs, str) else inputs
    outs = [regrid(raster(spark, p), grid, method).withColumn("input", F.lit(str(p))) for p in found]
    all_ = outs[0]
    for o in outs[1:]:
        all_ = all_.unionByName(o)
    return _out(all_, output, grid)


@command("normalize")
def normalize(spark, input, low=0.0, high=1.0, min=None, max=None, output=None):
    return _out(preprocess.normalize(raster(spark, input).cells, float(low), float(high), None if min is None else float(min), None if max is None else float(max)), output, _grid(spark, input, output))


@command("reclass")
def reclass(spark, input, remap="", nodata="", nodata_value=-9999, rule=None, output=None):
    r = raster(spark, input)
    mapping, gone = read_reclass(rule) if rule else (parse.remap(remap) if isinstance(remap, str) else dict(remap), _ints(nodata) if nodata else [])
    return _out(preprocess.reclassify(r.cells, mapping, gone, int(nodata_value), r.grid.dtype), output, r.grid)


@command("detect-change")
def detect_change(spark, before, after, encode=False, output=None):
    return _out(preprocess.change_map(_cells(spark, before=before, after=after), encode=encode), output, _grid(spark, before, output))


@command("compress")
def compress(spark, input, output, codec="deflate", level=None, max_error=0.0, overviews=""):
    sizes = preprocess.compress(raster(spark, input).cells, output, codec, level, float(max_error), _ints(overviews) if overviews else ())
    return spark.createDataFrame(sorted(sizes.items()), "level string, bytes bigint")


@command("ca-markov")
def ca_markov(spark, luccs, years, steps=1, step=10, output=None):
    files, when = (parse.paths(luccs) if isinstance(luccs, str) else luccs), _ints(years)
    if len(files) != len(when):
        raise ValueError("as many years as maps are needed")
    demand = markov.predict({y: raster(spark, f) for y, f in zip(when, files, strict=True)}, int(steps), int(step))
    if output:
        write_demand(demand, output)
    return demand


@command("ca-pg")
def ca_pg(spark, pre_lucc, now_lucc, drivers, method="rf", trees=60, select_rate=0.6, cap_changed=5000, cap_same=5000, seed=42, output=None):
    files = parse.paths(drivers) if isinstance(drivers, str) else drivers
    names = [f"d{k}" for k in range(len(files))]
    cells = _cells(spark, before=pre_lucc, after=now_lucc, **dict(zip(names, files, strict=True)))
    sample = transition_ml.samples(cells, names, cap_changed=int(cap_changed), cap_same=int(cap_same), seed=int(seed))
    model, classes = transition_ml.train(sample, names, method, int(trees), float(select_rate), int(seed))
    return _out(transition_ml.score(cells.withColumnRenamed("after", "v"), model, names, classes, "v").withColumn("classes", F.array(*[F.lit(c) for c in classes])), output, _grid(spark, pre_lucc, output))


@command("ca-simulate")
def ca_simulate(spark, lucc, pg, demand, year=0, transitions="", redline=None, iterations=10, neighbor=3, step_size=400.0, convergence=0.001, seed=42, mode="rounds", output=None, decay=None, binary=None):
    if decay is not None or binary is not None:
        warnings.warn("decay and binary are accepted for old calls and have no effect", stacklevel=2)
    table = spark.read.parquet(pg) if isinstance(pg, str) else pg
    classes = list(table.select("classes").first()[0])
    cells = raster(spark, lucc).cells.select("x", "y", "v").join(table.select("x", "y", "pg"), ["x", "y"])
    if redline:
        cells = cells.join(raster(spark, redline).named("redline"), ["x", "y"], "left")
    wanted = read_demand(spark, demand, classes, int(year)) if isinstance(demand, str) else dict(demand)
    out, _ = automata.simulate(cells, wanted, classes, _moves(transitions) if transitions else None, iterations=int(iterations), neighbours=int(neighbor), step_size=float(step_size), convergence=float(convergence), seed=int(seed), mode=mode)
    return _out(out.select("x", "y", "v"), output, _grid(spark, lucc, output))


@command("sdg-infra-simulate")
def infra_simulate(spark, lucc, zone, demand, year=0, iterations=10, neighbor=3, decay=0.92, convergence=0.001, seed=42, compat=True, output=None):
    cells = _cells(spark, v=lucc, zone=zone)
    n = read_binary_demand(spark, demand, int(year)) if isinstance(demand, str) else int(demand)
    out, _ = infrastructure.simulate(cells, n, int(iterations), int(neighbor), float(decay), float(convergence), int(seed), compat)
    return _out(out, output, _grid(spark, lucc, output))


@command("sdg-predict")
def predict(spark, pre_lucc, now_lucc, drivers, pre_year=2010, now_year=2020, types="1,2", iterations=10, method="rf", seed=42):
    """Probabilities, demand and simulation in turn; the indicator is read from the simulated map."""
    pg = ca_pg(spark, pre_lucc, now_lucc, drivers, method, seed=seed).checkpoint()
    rows = markov.predict({int(pre_year): raster(spark, pre_lucc), int(now_year): raster(spark, now_lucc)}, 1, int(now_year) - int(pre_year))
    last = rows.agg(F.max("year")).first()[0]
    wanted = {r["class"]: r["n"] for r in rows.filter(F.col("year") == last).collect()}  # a row a class
    simulated = ca_simulate(spark, now_lucc, pg, wanted, iterations=iterations, seed=seed)
    return indicators.land_proportion(simulated, _ints(types))


@command("pipeline")
def pipeline(spark, spec, variables=None, workers=4, done=None):
    """Run a pipeline of commands; returns (step, status)."""
    results = dag.run(spark, spec, COMMANDS, variables, workers, done)
    return spark.createDataFrame([(k, "skipped" if v is None else "done") for k, v in results.items()], "step string, status string")


@command("pipeline-dry-run")
def pipeline_dry_run(spark, spec):
    """What a pipeline would run: (level, step, command, problem), nothing is computed."""
    problems = dag.validate(spec, COMMANDS, lenient=True)
    if problems:
        return spark.createDataFrame([(None, None, None, p) for p in problems], _DRY)
    named = {s["id"]: s["run"] for s in spec["steps"]}
    return spark.createDataFrame([(k, i, named[i], None) for k, ids in enumerate(dag.levels(spec)) for i in ids], _DRY)


_DRY = "level int, step string, command string, problem string"


@command("pipeline-templates")
def pipeline_templates(spark, folder):
    """Pipeline files (JSON) of a folder: (name, steps, variables)."""
    found = []
    for path in sorted(Path(folder).glob("*.json")):
        spec = json.loads(path.read_text())
        found.append((spec.get("name", path.stem), len(spec.get("steps", [])), sorted(spec.get("vars", {}))))
    return spark.createDataFrame(found, "name string, steps int, variables array<string>")


@command("demo")
def demo(spark, init_lucc, curr_lucc, popu0, popu1, buffer, done=None):
    """The eight-step tour as a pipeline."""
    steps = [
        {"id": "proportion", "run": "sdg-land-proportion", "params": {"lucc": curr_lucc, "types": [2, 3]}},
        {"id": "conversion", "run": "sdg-land-conversion", "params": {"init_lucc": init_lucc, "curr_lucc": curr_lucc, "transitions": {2: [2, 5, 6], 4: [5]}}},
        {"id": "coverage", "run": "sdg-buffer-zone", "params": {"data": popu0, "buffer": buffer}},
        {"id": "growth", "run": "sdg-1131", "params": {"pre_lucc": init_lucc, "now_lucc": curr_lucc, "pre_popu": popu0, "now_popu": popu1, "types": [5]}},
        {"id": "emission", "run": "sdg-1322", "params": {"init_lucc": init_lucc, "curr_lucc": curr_lucc, "emission": EMISSION}},
        {"id": "loss", "run": "priority-loss", "params": {"init_lucc": init_lucc, "curr_lucc": curr_lucc, "types": [2, 3]}},
        {"id": "people", "run": "priority-human-land", "params": {"pre_lucc": init_lucc, "now_lucc": curr_lucc, "pre_popu": popu0, "now_popu": popu1, "types": [5]}},
        {"id": "change", "run": "detect-change", "params": {"before": init_lucc, "after": curr_lucc}, "depends_on": ["proportion"]},
    ]
    return pipeline(spark, {"name": "demo", "steps": steps}, done=done)


#: Default emission factors by class.
EMISSION = {1: -1.0, 2: -20.0, 3: -5.0, 4: -0.5, 5: 5.0, 6: 0.3}


def builtin_plugins() -> plugins.Registry:
    """The indicator and priority commands as plug-ins, with the commands' own defaults."""
    registry = plugins.Registry()
    for name, f in COMMANDS.items():
        if name.startswith(("sdg-", "priority-")) and name not in ("sdg-predict", "sdg-infra-simulate"):
            given = [p for p in _inspect.signature(f).parameters.values() if p.name != "spark"]
            parameters = [plugins.Parameter(p.name, required=p.default is p.empty, default=None if p.default is p.empty else p.default) for p in given]
            registry.add(plugins.Descriptor(name, __name__, f.__name__, __version__, parameters=parameters, builtin=True), lambda spark, kw, f=f: f(spark, **kw))
    return registry


def usage(name: str) -> str:
    """Help of one command: what it does and its parameters with their defaults."""
    f = COMMANDS[name]
    lines = [name, *([f"  {_inspect.getdoc(f)}"] if f.__doc__ else [])]
    for p in list(_inspect.signature(f).parameters.values())[1:]:
        lines.append(f"  --{parse.kebab(p.name)}  {'required' if p.default is p.empty else f'default {p.default}'}")
    return "\n".join(lines)


@command("list-indicators")
def list_indicators(spark):
    """The catalogue of indicators."""
    return catalogue.catalogue(spark)


@command("list-plugins")
def list_plugins(spark, folders=""):
    registry = builtin_plugins()
    registry.discover(*(parse.paths(folders) if folders else ()))
    return registry.table(spark)


@command("version")
def version(spark):
    return spark.createDataFrame([(__version__,)], "version string")


def main(argv: list[str]) -> None:
    """``python -m landloom.plans.commands <command> --name value ...``; unknown commands are plug-ins."""
    from ..session import local_session

    asked = [a for a in argv if a in COMMANDS]
    if asked and any(a in ("help", "--help", "-h") for a in argv[:2]):
        print(usage(asked[0]))
        return
    if not argv or argv[0] in ("help", "--help", "-h"):
        print("\n".join(f"{n}: {' '.join(parse.kebab(p) for p in _inspect.signature(f).parameters if p != 'spark')}" for n, f in sorted(COMMANDS.items())))
        return
    name, rest = {"--version": "version", "-v": "version"}.get(argv[0], argv[0]), argv[1:]
    given: dict[str, Any] = {}
    k = 0
    while k < len(rest):
        key = rest[k].removeprefix("--").replace("-", "_")
        if k + 1 < len(rest) and not rest[k + 1].startswith("--"):
            given[key], k = rest[k + 1], k + 2
        else:
            given[key], k = True, k + 1
    spark = local_session()
    folders = given.pop("plugin_dir", "")
    if name in COMMANDS:
        df = COMMANDS[name](spark, **given)
    else:
        registry = builtin_plugins()
        registry.discover(*parse.paths(folders))
        df = registry.call(spark, name, given)
    df.show(truncate=False)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
