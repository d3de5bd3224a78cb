"""Sources, parsers, plug-ins, pipelines and commands."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import parse
from landloom.grid import Grid
from landloom.operators import knowledge, manifest, markov, registry, reports, rules
from landloom.plans import commands, dag, plugins
from landloom.sources import geotiff, tables


@pytest.mark.parametrize("dtype", ["Byte", "Int16", "UInt16", "Int32", "Float32", "Float64"])
def test_geotiff_round_trip(spark, tmp_path, dtype):
    a = np.arange(60).reshape(6, 10).astype(geotiff.NUMPY[dtype])
    grid = Grid(10, 6, (100.0, 30.0, 0.0, 200.0, 0.0, -30.0), "EPSG:3857", 7.0, dtype)
    path = tmp_path / "a.tif"
    path.write_bytes(geotiff.encode(a, grid))
    assert geotiff.header_of(str(path)).grid == grid
    spark.dataSource.register(geotiff.GeoTiffSource)
    rows = spark.read.format("geotiff").load(str(path)).collect()
    assert {(r["x"], r["y"]): r["v"] for r in rows} == {(x, y): (None if a[y, x] == 7 else float(a[y, x])) for x in range(10) for y in range(6)}
    out, df = tmp_path / "out.tif", spark.read.format("geotiff").load(str(path))
    geotiff.write_geotiff(df.repartition(4, "x", "y"), str(out), grid)  # dealt by hash, as after any join
    assert list(out.glob("*.tif")) and not list(out.glob("*.tmp")) and geotiff.grid_of(str(out)) == grid
    again = spark.read.format("geotiff").load(str(out)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    meta = manifest.scan(spark, str(tmp_path)).filter(F.col("path").endswith("a.tif")).first()
    assert (meta["width"], meta["height"], meta["dtype"], meta["epsg"], meta["res"]) == (10, 6, dtype, "EPSG:3857", 30.0)


def test_bands(spark, tmp_path):
    a = np.arange(24).reshape(2, 4, 3).astype("f4")
    (tmp_path / "b.tif").write_bytes(geotiff.encode(a, Grid(4, 2, dtype="Float32", bands=3)))
    spark.dataSource.register(geotiff.GeoTiffSource)
    rows = spark.read.format("geotiff").option("bands", "all").load(str(tmp_path / "b.tif")).collect()
    assert {(r["x"], r["y"]): r["bands"] for r in rows}[1, 1] == a[1, 1].tolist()


def test_bands_round_trip_in_strips(spark, tmp_path, monkeypatch):
    grid = Grid(7, 9, (0.0, 10.0, 0.0, 90.0, 0.0, -10.0), "EPSG:3857", -1.0, "Float32", 2)
    cells = spark.createDataFrame([(x, y, [x + 0.5, None if x == y else float(y)]) for x in range(7) for y in range(9)], "x int, y int, bands array<double>")
    rows = geotiff.strip_rows(grid)
    assert rows == 9
    geotiff.write_geotiff(cells.repartition(3, "x"), str(tmp_path / "k.tif"), grid)
    got = spark.read.format("geotiff").option("bands", "all").load(str(tmp_path / "k.tif")).collect()
    assert {(r["x"], r["y"]): r["bands"] for r in got} == {(r["x"], r["y"]): r["bands"] for r in cells.collect()}


def test_strips_by_hand(tmp_path, monkeypatch):
    """Strips of two rows from batches in order, each at its own place; a strip of two tasks is refused."""
    import pyarrow as pa

    class Task:
        def taskAttemptId(self):
            return 5

    monkeypatch.setattr(geotiff, "STRIP_CELLS", 8)
    monkeypatch.setattr(geotiff.TaskContext, "get", classmethod(lambda cls: Task()))
    w = geotiff._Writer({"path": str(tmp_path), "width": "4", "height": "5", "nodata": "0"}, True)
    batch = lambda ys: pa.RecordBatch.from_arrays([pa.array([1] * len(ys), pa.int32()), pa.array(ys, pa.int32()), pa.array([float(y + 1) for y in ys])], ["x", "y", "v"])
    done = w.write(iter([batch([0, 1, 2]), batch([3, 4])]))
    w.commit([done])
    assert sorted(p.name for p in tmp_path.glob("*.tif")) == [f"strip-{k:09d}.tif" for k in (0, 2, 4)]
    assert [geotiff.header_of(str(p)).grid.height for p in sorted(tmp_path.glob("*.tif"))] == [2, 2, 1]
    with pytest.raises(geotiff.GridError):
        w.commit([w.write(iter([batch([0])])), w.write(iter([batch([1])]))])


def test_outputs_keep_their_grid(spark, tmp_path):
    grid = Grid(4, 3, (500.0, 30.0, 0.0, 900.0, 0.0, -30.0), "EPSG:3857", 0.0, "Byte")
    a = np.array([[1, 2, 3, 4], [2, 2, 2, 2], [0, 1, 1, 3]], "u1")
    (tmp_path / "a.tif").write_bytes(geotiff.encode(a, grid))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(a[::-1].copy(), grid))
    for out in (str(tmp_path / "m.parquet"), str(tmp_path / "m.tif")):
        commands.COMMANDS["priority-loss"](spark, str(tmp_path / "a.tif"), str(tmp_path / "b.tif"), "1,2", output=out)
        back = commands.raster(spark, out)
        assert (back.grid.width, back.grid.height, back.grid.transform, back.grid.crs) == (4, 3, grid.transform, grid.crs)
        assert back.cells.count() == 12


def test_report_checks(spark):
    rep = spark.createDataFrame([(1, "trend", "趋势概述 时间序列分析 结论 c1", "t", "p"), (2, "composite", "{{ x }} 执行摘要", "", "p"), (3, "trend", None, "t", "p")], "report_id int, template string, content string, title string, period string")
    ind = spark.createDataFrame([(1, "score", "a", "50", "%", False), (2, "score", "a", "500", None, True), (2, "c", "b", "x", "m", False)], "report_id int, code string, name string, value string, unit string, nodata_handled boolean")
    cha = spark.createDataFrame([(1, "c1", "p/q.png"), (2, "c2", "z.png")], "report_id int, chart_id string, path string")
    got = reports.checks(rep, ind, cha, spark.createDataFrame([("p/q.png",)], "path string"))
    by = {}
    for r in got.collect():
        by.setdefault(r["report_id"], {})[r["rule_id"]] = r["severity"]
    assert by == {1: dict.fromkeys(range(1, 10), "PASS"), 2: {1: "FAIL", 2: "WARN", 3: "FAIL", 4: "FAIL", 5: "WARN", 6: "WARN", 7: "WARN", 8: "FAIL", 9: "PASS"}, 3: {9: "FAIL"}}
    assert {r["report_id"]: r["overall"] for r in reports.verdicts(got).collect()} == {1: "PASS", 2: "FAIL", 3: "FAIL"}


def test_demand_files(spark, tmp_path):
    demand = spark.createDataFrame([(2010, 1, 5), (2010, 2, 6), (2020, 1, 4), (2020, 2, 7)], "year int, class bigint, n bigint")
    tables.write_demand(demand, str(tmp_path / "d"))
    assert tables.read_demand(spark, str(tmp_path / "d"), [1, 2]) == {1: 4, 2: 7}
    assert tables.read_demand(spark, str(tmp_path / "d"), [1, 2], 2010) == {1: 5, 2: 6}
    assert [r.asDict() for r in markov.wide(demand).orderBy("Year").collect()][0] == {"Year": 2010, "Type1": 5, "Type2": 6}
    (tmp_path / "b.csv").write_text("# note\nyear,count\n2010,5\n2020,9\n")
    assert tables.read_binary_demand(spark, str(tmp_path / "b.csv")) == 9
    assert tables.read_binary_demand(spark, str(tmp_path / "b.csv"), 2010) == 5
    assert tables.read_binary_demand(spark, str(tmp_path / "b.csv"), 1999) == 9
    (tmp_path / "log").write_text("x\n" + tables.checkpoint_line(1, 8, "one") + "\n" + tables.checkpoint_line(2, 8, "two") + "\n")
    assert tables.last_checkpoint(spark, str(tmp_path / "log")).first()[:] == (2, 8, "two")
    assert tables.parse_result(tables.result_lines({"score": 1.5, "n": 3})) == {"score": 1.5, "n": 3.0}


def test_parsers():
    assert parse.transitions("2:5:6,4:5") == parse.transitions("2>5,2>6,4>5") == {2: [5, 6], 4: [5]}
    assert parse.factors("1:-1,4:-0.5") == {1: -1.0, 4: -0.5}
    assert parse.version("1.2") < parse.version("1.10.0") and parse.boolean("Yes") and not parse.boolean("no")
    assert parse.command_line("a", {"init_lucc": "x", "compat": True, "none": None, "types": [1, 2]}) == ["a", "--init-lucc", "x", "--compat", "--types", "1,2"]
    assert parse.epsg('X AUTHORITY["EPSG","1"] AUTHORITY["EPSG","4326"]') == "EPSG:4326"
    assert parse.output_name("a/b.tif") == "a/b_resampled.tif"
    with pytest.raises(ValueError):
        parse.integers("1,x")


def test_plugins(spark, tmp_path):
    folder = tmp_path / "demo"
    folder.mkdir()
    (folder / "plugin.json").write_text(json.dumps({"name": "demo", "library": "demo.py", "class": "Demo", "minVersion": "9.0", "parameters": [{"name": "n", "required": True}, {"name": "m", "default": 2}]}))
    (folder / "demo.py").write_text("class Demo:\n    def run(self, spark, p):\n        return spark.range(int(p['n']) * int(p['m']))\n")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "plugin.json").write_text("{}")
    r = commands.builtin_plugins()
    assert r.discover(str(tmp_path)) == ["demo"] and len(r.warnings) == 2
    assert r.call(spark, "demo", {"n": 3}).count() == 6
    with pytest.raises(plugins.PluginError):
        r.call(spark, "demo")
    with pytest.raises(plugins.PluginError):
        r.discover(str(tmp_path)) if False else r.add(r.known["demo"][0])
    assert "--n <string> (required)" in r.help("demo")
    assert r.table(spark).filter("name = 'sdg-1131' and builtin").count() == 1


def test_pipeline():
    seen = []
    ops = {"add": lambda spark, a, b=0: seen.append((a, b)) or {"sum": int(a) + int(b)}}
    spec = {"vars": {"k": 4}, "steps": [{"id": "s", "run": "add", "params": {"a": "${k}", "b": 1}}, {"id": "t", "run": "add", "params": {"a": "${s.output.sum}"}, "depends_on": ["s"]}, {"id": "u", "run": "add", "params": {"a": 0}, "when": "false"}]}
    assert dag.levels(spec) == [["s", "u"], ["t"]]
    out = dag.run(None, spec, ops)
    assert out["t"] == {"sum": 5} and out["u"] is None
    before = len(seen)
    dag.run(None, spec, ops, done={"s": {"sum": 9}})
    assert (9, 0) in seen[before:] and (4, 1) not in seen[before:]
    assert dag.validate({"steps": [{"id": "a", "run": "x", "depends_on": ["b"]}]}, ops, lenient=True)
    with pytest.raises(dag.PipelineError):
        dag.levels({"steps": [{"id": "a", "depends_on": ["b"]}, {"id": "b", "depends_on": ["a"]}]})
    assert "error" in dag.batch(None, [{"name": "bad", "steps": [{"id": "a", "run": "x"}]}], ops, fail_fast=False)[0]


def test_commands(spark, tmp_path):
    n = 10
    cells = spark.createDataFrame([(x, y, 1 + (x + y) % 3, 1 + (x + 2 * y) % 3, float(x + 1)) for x in range(n) for y in range(n)], "x int, y int, a int, b int, p double")
    for c in "abp":
        cells.select("x", "y", F.col(c).alias("v")).write.parquet(str(tmp_path / c))
    a, b, p = (str(tmp_path / c) for c in "abp")
    run = commands.COMMANDS
    assert run["sdg-land-proportion"](spark, a, "1,2").first()["n_valid"] == n * n
    assert run["priority-merge"](spark, [run["priority-loss"](spark, a, b, "1", output=str(tmp_path / "m")) and str(tmp_path / "m")]).count() == n * n
    assert run["correlation"](spark, "1,2,3", "2,4,6").first()["r"] == pytest.approx(1)
    assert run["check"](spark, a).first()["errors"] == []
    assert run["detect-change"](spark, a, b, True).count() == n * n
    pg = run["ca-pg"](spark, a, b, [p, a], "logit", cap_changed=50, cap_same=50).cache()
    out = run["ca-simulate"](spark, b, pg, {1: 30, 2: 40, 3: 30}, iterations=1)
    assert out.count() == n * n
    assert run["demo"](spark, a, b, p, p, a).filter("status = 'done'").count() == 8
    assert run["list-plugins"](spark).count() > 10
    assert run["list-indicators"](spark).count() == 27
    with pytest.warns(UserWarning, match="no effect"):
        run["ca-simulate"](spark, b, pg, {1: 30, 2: 40, 3: 30}, iterations=1, decay=0.9)


def test_pipeline_commands(spark, tmp_path, capsys):
    spec = {"name": "two", "vars": {"k": 1}, "steps": [{"id": "b", "run": "version", "depends_on": ["a"]}, {"id": "a", "run": "list-plugins"}]}
    plan = commands.COMMANDS["pipeline-dry-run"](spark, spec).collect()
    assert sorted((r["level"], r["step"], r["command"]) for r in plan) == [(0, "a", "list-plugins"), (1, "b", "version")]
    bad = commands.COMMANDS["pipeline-dry-run"](spark, {"steps": [{"id": "a", "run": "none"}]}).first()
    assert bad["level"] is None and "none" in bad["problem"]
    (tmp_path / "two.json").write_text(json.dumps(spec))
    assert [tuple(r) for r in commands.COMMANDS["pipeline-templates"](spark, str(tmp_path)).collect()] == [("two", 2, ["k"])]
    for argv in (["help", "ca-pg"], ["ca-pg", "--help"]):
        commands.main(argv)
        said = capsys.readouterr().out
        assert "--pre-lucc  required" in said and "--cap-changed  default 5000" in said


def test_origin_without_projection():
    assert Grid(4, 3, (0.0, 1.0, 0.0, 7.0, 0.0, -1.0)).fixed().transform[3] == 3.0
    assert Grid(4, 3, (0.0, 1.0, 0.0, 7.0, 0.0, -1.0), "EPSG:3857").fixed().transform[3] == 7.0


def test_knowledge(spark):
    text = "intro\n# A\n" + "word " * 30 + "\n## B\n" + "other " * 40 + "\n# C\nlast one"
    got = knowledge.chunk_text(text, most=25)
    assert [g[2] for g in got if g[2]][0] == "A" and "A > B" in {g[2] for g in got} and got[-1][1] == "C"
    df = spark.createDataFrame([("s", text), ("t", None)], "source string, text string")
    chunks = knowledge.embed(knowledge.chunk(df, most=25), 8)
    assert chunks.filter("source = 't'").count() == 0 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in chunks.collect())
    q = knowledge.hash_embedding(got[0][0], 8).tolist()
    top = knowledge.top_k(chunks.withColumn("vec_id", F.col("chunk_index")), q, 1).first()
    assert top["text"] == got[0][0] and top["score"] == pytest.approx(1)
    again = knowledge.add_document(knowledge.add_document(None, df, most=25), df, most=25)
    assert again.count() == chunks.count()


def test_registry_and_manifest(spark):
    old = spark.createDataFrame([("a", "r", None, 2000, 1, "1")], registry.FILES)
    new = spark.createDataFrame([("a", "", "c", None, None, "2"), ("b", "q", None, None, None, "2")], registry.FILES)
    rows = {r["path"]: r for r in registry.upsert(old, new).collect()}
    assert rows["a"]["count"] == 2 and rows["a"]["region"] == "r" and rows["a"]["category"] == "c" and rows["b"]["count"] == 1
    names = spark.createDataFrame([("lucc_2020_ssp2.tif",), ("人口_1950.tif",), ("x_12020.tif",)], "n string")
    got = names.select(manifest.file_year(F.col("n")), manifest.file_scenario(F.col("n")), manifest.file_category(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(2020, "ssp2_45", "lucc"), (1950, None, "pop"), (None, None, "unknown")]
    listed = manifest.read(spark, json.dumps({"datasets": {"d": {"files": ["a.tif", {"file": "b.tif", "year": 3000}]}}}))
    assert manifest.orphans(listed, spark.createDataFrame([("a.tif",), ("z.tif",)], "path string")).count() == 2
    assert {r["problem"] for r in manifest.integrity(listed, [], ["d"]).collect()} == {"year_out_of_range"}
    old_paths = spark.createDataFrame([("2020/ssp1/gdp.tif",)], "path string")
    assert manifest.legacy(old_paths).first()[1:] == ("2020", "ssp1", "gdp")


def test_rules(spark):
    df = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    assert df.filter(rules.predicate("v", ">=", 90) == 1).count() == 10
    assert rules.ranking(df, "v", 5).filter("score = 1").count() == 5
    assert rules.breaks(df, "v", "equal_interval", 4) == [24.75, 49.5, 74.25]
    split = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 50.0, 51.0, 99.0, 100.0]], "v double")
    a, b = rules.breaks(split, "v", "natural_breaks", 3)
    assert 2 < a < 50 and 51 < b < 99
    with pytest.raises(ValueError):
        rules.evaluate(df, [{"id": "a", "type": "composite", "sub_rules": ["b"]}, {"id": "b", "type": "composite", "sub_rules": ["a"]}])
    routed = rules.route(spark.createDataFrame([("Run it",), ("nothing",), (None,)], "text string"), [{"name": "exec", "priority": 1, "keywords": ["run"]}])
    assert [r["intent"] for r in routed.collect()] == ["exec", "unknown", "unknown"]
