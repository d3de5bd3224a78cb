"""Dataset manifests: scanning, building, reading and checking."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category keywords; CJK ones weigh double.
CATEGORIES = {
    "lucc": "lucc landuse landcover land_use land_cover cls classification lc 土地利用 土地覆盖 分类".split(),
    "pop": "pop population gpw density popu 人口 人口密度".split(),
    "carbon": "carbon emission co2 ghg co2e 碳 排放 二氧化碳".split(),
    "carbon_forest": "forest_carbon sink biomass carbon_forest carbon_sink 森林碳汇 碳汇 生物量".split(),
    "elevation": "dem elevation aster srtm altitude dtm 高程 地形 海拔".split(),
    "slope": "slope gradient aspect 坡度 坡向".split(),
    "water": "water lake river wetland hydro stream 水体 水域 湖泊 河流 湿地".split(),
    "ndvi": "ndvi vegetation greenness vi evi 植被 指数 归一化植被".split(),
    "dist2city": "dist2city dist_city city_dist urban_dist dis_city 城市距离 到城市".split(),
    "dist2water": "dist2water dist_water water_dist dis_water 水体距离 到水体".split(),
    "dist2road": "dist2road dist_road road_dist dist2highway dis_road 道路距离 到道路".split(),
    "esv": "esv ecosystem service esv_value 生态服务 生态系统".split(),
    "nightlight": "nightlight night_light npp viirs dmsp ntl 夜间灯光 灯光 夜光".split(),
    "impervious": "impervious isa imperviousness imp 不透水".split(),
    "gdp": "gdp economic product gdp_ppp 生产总值 经济".split(),
    "agri_suit": "agri agriculture suitability mca cropland_suit farming 农业适宜 耕地适宜".split(),
}
#: Scenario patterns in order of precedence.
SCENARIOS = (("ssp1_26", "ssp1"), ("ssp2_45", "ssp2"), ("ssp3_70", "ssp3"), ("ssp5_85", "ssp5"), ("baseline", "baseline"))
#: Fixed value: the year of a file whose name has none.
DEFAULT_YEAR = 2020
STAGES = ("scan", "classify", "standardize", "manifest", "validate", "report")


def file_year(name: Column) -> Column:
    """The first number of four digits set apart in a name, if it is a year from 1900 to 2100."""
    y = F.regexp_extract(name, r"(?:^|[_\-\s])([0-9]{4})(?:[_\-\s.]|$)", 1).try_cast("int")
    return F.when(y.between(1900, 2100), y)


def _plain(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def file_scenario(name: Column) -> Column:
    """The scenario that a name tells (its numbers may follow: ssp245, ssp2_45); null without one."""
    low = _plain(name)
    out = F.when(F.contains(low, F.lit(SCENARIOS[0][1])), SCENARIOS[0][0])
    for label, mark in SCENARIOS[1:]:
        out = out.when(F.contains(low, F.lit(mark)), label)
    return out


def file_category(name: Column) -> Column:
    """The category whose matching keywords weigh most (the first of equals); ``unknown`` without a match."""
    scores = []
    for k, (label, words) in enumerate(CATEGORIES.items()):
        total = sum((F.when(F.contains(_plain(name) if w.isascii() else name, F.lit(w)), len(w) * (1 if w.isascii() else 2)).otherwise(0) for w in words), F.lit(0))
        scores.append(F.struct(total.alias("n"), F.lit(-k).alias("k"), F.lit(label).alias("c")))
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["c"]).otherwise("unknown")


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """TIFF files under a folder: path, size_mb, width, height, bands, dtype, epsg, res, nodata (headers read on the executors)."""
    from ..sources.geotiff import describe_files

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return describe_files(files)


def build(files: DataFrame, project: str) -> dict:
    """A manifest: one dataset per category with its files; the resolution of its first file that has one."""
    rows = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = rows.select(file_category(F.col("name")).alias("category"), F.struct("path", F.coalesce(file_year(F.col("name")), F.lit(DEFAULT_YEAR)).alias("year"), file_scenario(F.col("name")).alias("scenario")).alias("file"), F.struct(F.col("res").isNull(), "path", "res").alias("r"))
    grouped = rows.groupBy("category").agg(F.sort_array(F.collect_list("file")).alias("files"), F.min("r").getField("res").alias("resolution"))
    datasets = [{"id": r["category"], "resolution": r["resolution"], "files": [f.asDict() for f in r["files"]]} for r in grouped.orderBy("category").collect()]
    return {"project": {"name": project}, "datasets": datasets}


def read(spark: SparkSession, text: str) -> DataFrame:
    """Files of a manifest, whose datasets are a list or an object and whose entries name a path, file or name."""
    loaded = json.loads(text).get("datasets", [])
    sets = [{"id": k, **v} for k, v in loaded.items()] if isinstance(loaded, dict) else loaded
    rows = []
    for d in sets:
        for part in (d, *d.get("subcategories", [])):
            for f in part.get("files", []):
                f = {"path": f} if isinstance(f, str) else f
                rows.append((d.get("id") or d.get("name"), f.get("path") or f.get("file") or f.get("name"), f.get("year"), f.get("scenario"), f.get("region"), f.get("crs")))
    return spark.createDataFrame(rows, "dataset string, path string, year int, scenario string, region string, crs string")


def orphans(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths on one side only: (path, problem)."""
    a, b = manifest.select("path").distinct(), disk.select("path").distinct()
    return b.join(a, "path", "left_anti").withColumn("problem", F.lit("orphan")).unionByName(a.join(b, "path", "left_anti").withColumn("problem", F.lit("missing")))


def crs_conflicts(files: DataFrame) -> DataFrame:
    """Datasets with more than one projection."""
    return files.groupBy("dataset").agg(F.array_sort(F.collect_set("crs")).alias("crs")).filter(F.size("crs") > 1)


def integrity(files: DataFrame, scenarios: list[str], datasets: list[str]) -> DataFrame:
    """(path, problem): years out of range, undeclared scenarios, unknown datasets, missing paths."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("path").isNull(), "no_path"),
            F.when(~F.col("year").between(1900, 2100), "year_out_of_range"),
            F.when(F.col("scenario").isNotNull() & ~F.col("scenario").isin(scenarios), "scenario_not_declared"),
            F.when(~F.col("dataset").isin(datasets), "unknown_dataset"),
        )
    )
    return files.select("path", F.explode(problems).alias("problem"))


def legacy(paths: DataFrame, pattern: str = "{year}/{scenario}/{indicator}.tif") -> DataFrame:
    """Fields of paths laid out by a pattern of names in braces."""
    import re

    names = re.findall(r"\{(\w+)\}", pattern)
    rx = "(?:^|/)" + re.sub(r"\\\{\w+\\\}", "([^/]+?)", re.escape(pattern)) + "$"
    return paths.select("path", *[F.nullif(F.regexp_extract("path", rx, k), F.lit("")).alias(n) for k, n in enumerate(names, 1)])


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + root.rstrip("/").replace(".", "\\.") + "/", "")
