"""Declared rules: predicates, rankings, change rates, composites, classification, confidence and grading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {"<": "<", "<=": "<=", ">": ">", ">=": ">=", "==": "=", "!=": "<>"}
#: Highest wins in a roll-up.
SEVERITY = {"PASS": 0, "INFO": 1, "WARN": 2, "FAIL": 3}


def predicate(column: str, operator: str, value: float) -> Column:
    """A declared comparison as 0 or 1; NULL compares false."""
    return F.coalesce(F.expr(f"`{column}` {_COMPARE[operator]} {float(value)}D").cast("double"), F.lit(0.0))


def condition(text: str) -> Column:
    """A declared condition such as ``PA == 1 AND UA == 0`` over columns of that name."""
    return F.coalesce(F.expr(text.replace("==", "=").replace("&&", " AND ").replace("||", " OR ")), F.lit(False))


def ranking(df: DataFrame, column: str, percentile: float, top: bool = True, name: str = "score") -> DataFrame:
    """1 for values within the top (or bottom) percentile, found by an exact percentile aggregation."""
    cut = df.agg(F.percentile(column, (100 - percentile) / 100 if top else percentile / 100).alias("_cut"))
    c, k = F.col(column), F.col("_cut")
    return df.join(F.broadcast(cut)).withColumn(name, F.coalesce((c >= k if top else c <= k).cast("double"), F.lit(0.0))).drop("_cut")  # one row


def change_rate(before: str, after: str, operator: str, value: float) -> Column:
    """Relative change between two columns against a bound."""
    rate = F.try_divide(F.col(after) - F.col(before), F.abs(before))
    out = {"<": rate < value, "<=": rate <= value, ">": rate > value, ">=": rate >= value, "==": rate == value, "!=": rate != value}[operator]
    return F.coalesce(out.cast("double"), F.lit(0.0))


def within(mask: DataFrame, distance: int) -> DataFrame:
    """A spatial rule: 1 for cells within so many cells (in either direction) of a marked one; dense grid."""
    from .focal import box_sum

    out = box_sum(mask.select("x", "y", F.coalesce(F.col("v").cast("int"), F.lit(0)).alias("v")), ["v"], -distance, distance)
    return out.select("x", "y", (F.col("box_v") > 0).cast("double").alias("score"))


def composite(scores: list[str], aggregation: str, weights: Mapping[str, float] | None = None) -> Column:
    """Combine rule columns in [0, 1]: weighted_sum, geometric_mean, min, max, fuzzy_and, fuzzy_or."""
    columns = [F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scores]
    w = [float((weights or {}).get(s, 1.0)) for s in scores]
    if aggregation == "weighted_sum":
        return sum((c * (k / sum(w)) for c, k in zip(columns, w, strict=True)), F.lit(0.0))
    if aggregation == "geometric_mean":
        logs = sum((F.log(F.when(c > 0, c)) * (k / sum(w)) for c, k in zip(columns, w, strict=True)), F.lit(0.0))
        return F.coalesce(F.exp(logs), F.lit(0.0))
    if aggregation in ("min", "fuzzy_and"):
        return columns[0] if len(columns) == 1 else F.least(*columns)
    if aggregation in ("max", "fuzzy_or"):
        return columns[0] if len(columns) == 1 else F.greatest(*columns)
    raise ValueError(f"unknown aggregation {aggregation}")


def evaluate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Add a column per rule (id -> 0..1). Composites name other rules or hold them inline."""
    made: dict[str, dict] = {}

    def flatten(rule: dict) -> str:
        name = rule["id"]
        subs = [flatten(s) if isinstance(s, dict) else s for s in rule.get("sub_rules", [])]
        made[name] = {**rule, "sub_rules": subs}
        return name

    for r in rules:
        flatten(r)
    done: set[str] = set()

    def add(frame: DataFrame, name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in done:
            return frame
        if name in path:
            raise ValueError(f"rules refer to each other: {' > '.join((*path, name))}")
        if name not in made:
            raise ValueError(f"unknown rule {name}")
        rule = made[name]
        for s in rule["sub_rules"]:
            frame = add(frame, s, (*path, name))
        c = rule.get("condition", {})
        column = c.get("indicator") or c.get("dataset")
        kind = rule["type"]
        if kind == "threshold":
            frame = frame.withColumn(name, predicate(column, c["operator"], c["value"]))
        elif kind == "ranking":
            frame = ranking(frame, column, c["percentile"], c.get("ranking", "top") == "top", name)
        elif kind == "change_rate":
            frame = frame.withColumn(name, change_rate(c["before"], c["after"], c["operator"], c["value"]))
        elif kind == "spatial":
            frame = frame.withColumn(name, predicate(column, "<=", c["distance"]))
        elif kind == "composite":
            weights = {s: float(made[s].get("weight", 1.0)) for s in rule["sub_rules"]}
            frame = frame.withColumn(name, composite(rule["sub_rules"], rule.get("aggregation", "weighted_sum"), weights))
        else:
            raise ValueError(f"unknown rule type {kind}")
        done.add(name)
        return frame

    for name in list(made):
        df = add(df, name)
    return df


def breaks(df: DataFrame, column: str, method: str, classes: int = 5, manual: list[float] | None = None, bins: int = 1024) -> list[float]:
    """Inner class bounds: equal_interval, quantile, natural_breaks (on a histogram) or manual; 2 to 10 classes."""
    if method == "manual":
        return sorted(manual or [])
    if not 2 <= classes <= 10:
        raise ValueError("2 to 10 classes")
    if method == "quantile":
        row = df.agg(F.percentile(column, F.array(*[F.lit(k / classes) for k in range(1, classes)])).alias("q")).first()
        return [float(x) for x in row["q"] or []]
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
    a, b = ends["a"], ends["b"]
    if a is None or a == b:
        return []
    if method == "equal_interval":
        return [a + (b - a) * k / classes for k in range(1, classes)]
    if method != "natural_breaks":
        raise ValueError(f"unknown method {method}")
    slot = F.least(F.floor((F.col(column) - a) / (b - a) * bins), F.lit(bins - 1))
    histogram = {int(r["s"]): int(r["n"]) for r in df.filter(F.col(column).isNotNull()).groupBy(slot.alias("s")).agg(F.count("*").alias("n")).collect()}  # bins rows
    return _natural([(a + (b - a) * (s + 0.5) / bins, n) for s, n in sorted(histogram.items())], classes)


def _natural(points: list[tuple[float, int]], classes: int) -> list[float]:
    """Bounds that minimise the squared deviation within classes, by dynamic programming over the bins."""
    import numpy as np

    x, w = (np.array(c, float) for c in zip(*points, strict=True))
    classes = min(classes, len(x))
    sw, sx, sxx = (np.concatenate(([0.0], np.cumsum(c))) for c in (w, w * x, w * x * x))
    i = np.arange(len(x) + 1)

    def cost(j):  # of the bins i..j-1 for every i < j
        n = sw[j] - sw[i[:j]]
        return sxx[j] - sxx[i[:j]] - (sx[j] - sx[i[:j]]) ** 2 / n

    best = np.full((classes + 1, len(x) + 1), np.inf)
    cut = np.zeros((classes + 1, len(x) + 1), int)
    best[0, 0] = 0
    for j in range(1, len(x) + 1):
        c = cost(j)
        for k in range(1, classes + 1):
            total = best[k - 1, :j] + c
            cut[k, j] = int(np.argmin(total))
            best[k, j] = total[cut[k, j]]
    out, j = [], len(x)
    for k in range(classes, 1, -1):
        j = cut[k, j]
        out.append((x[j - 1] + x[j]) / 2 if j else x[0])
    return sorted(out)


def classify(column: str, bounds: list[float]) -> Column:
    """Class 1.. by bounds (a value on a bound is in the upper class); NULL stays."""
    c = F.col(column)
    return F.when(c.isNotNull(), sum(((c >= b).cast("int") for b in bounds), F.lit(1)))


def dimension_scores(scores: DataFrame) -> DataFrame:
    """(indicator, dimension, score) -> mean per dimension."""
    return scores.groupBy("dimension").agg(F.avg("score").alias("score"))


def composite_score(scores: DataFrame) -> DataFrame:
    """Mean of the dimensions' means."""
    return dimension_scores(scores).agg(F.avg("score").alias("composite"))


def confidence(df: DataFrame, weights: Mapping[str, float], overrides: Mapping[str, Mapping[str, float]] | None = None, tool: str = "tool") -> DataFrame:
    """Weighted sum of factor columns, with other weights for some tools; and its label."""

    def total(w: Mapping[str, float]) -> Column:
        return sum((F.coalesce(F.col(k), F.lit(0.0)) * float(v) for k, v in w.items()), F.lit(0.0))

    out = total(weights)
    for name, w in (overrides or {}).items():
        out = F.when(F.col(tool) == name, total({**weights, **w})).otherwise(out)
    c = df.withColumn("confidence", out)
    return c.withColumn("label", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").when(F.col("confidence") >= 0.4, "low").otherwise("very_low"))


def validate(results: DataFrame, rules: list[dict]) -> DataFrame:
    """Range checks and anomaly patterns per tool: (tool, rule, severity, hit) rows.

    ``rules``: tool, metric, valid_range {min, max}, anomaly_patterns [{id, condition, severity}]; ``results`` has tool
    and the metric columns.
    """
    parts = []
    for r in rules:
        own = results.filter(F.col("tool") == r["tool"])
        bounds = r.get("valid_range")
        if bounds:
            bad = F.coalesce(~F.col(r["metric"]).between(bounds["min"], bounds["max"]), F.lit(True))
            parts.append(own.select("tool", F.lit("valid_range").alias("rule"), F.lit("FAIL").alias("severity"), bad.alias("hit")))
        for p in r.get("anomaly_patterns", []):
            parts.append(own.select("tool", F.lit(p["id"]).alias("rule"), F.lit(p["severity"].upper()).alias("severity"), condition(p["condition"]).alias("hit")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roll_up(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Overall severity per tool: the highest of the hits; ``strict`` counts a warning as a failure."""
    names = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    rank = F.when(F.col("hit"), F.try_element_at(names, F.col("severity"))).otherwise(0)
    top = checks.groupBy("tool").agg(F.max(rank).alias("r"))
    level = F.when((F.col("r") == 2) & F.lit(strict), 3).otherwise(F.col("r"))
    return top.select("tool", F.element_at(F.array(*[F.lit(k) for k in SEVERITY]), (level + 1).cast("int")).alias("overall"))


def diagnose(symptoms: DataFrame, patterns: DataFrame, most: int = 3) -> DataFrame:
    """(symptom) by (symptom, causes array<struct<cause, confidence>>) -> the likeliest causes in order."""
    causes = symptoms.join(patterns, "symptom").select("symptom", F.explode("causes").alias("c")).select("symptom", "c.*")
    place = Window.partitionBy("symptom").orderBy(F.col("confidence").desc(), "cause")
    return causes.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)


def grade(indicators: DataFrame, key: str, triggered: str) -> DataFrame:
    """Share of triggered indicators per key and its grade: low up to 20 %, moderate 40 %, high 60 %, else critical."""
    share = indicators.groupBy(key).agg((F.count_if(F.col(triggered)) / F.count("*")).alias("share"))
    s = F.col("share")
    return share.withColumn("grade", F.when(s < 0.2, "low").when(s < 0.4, "moderate").when(s < 0.6, "high").otherwise("critical"))


def route(utterances: DataFrame, intents: list[dict], text: str = "text") -> DataFrame:
    """Intent of each text: the first by priority whose keywords or patterns match; ``unknown`` where none does."""
    out = None
    low = F.lower(F.coalesce(text, F.lit("")))
    for i in sorted(intents, key=lambda i: (i.get("priority", 0), i["name"])):
        hit = F.lit(False)
        for k in i.get("keywords", []):
            hit = hit | F.contains(low, F.lit(k.lower()))
        for p in i.get("patterns", []):
            hit = hit | F.coalesce(F.col(text).rlike(p), F.lit(False))
        out = F.when(hit, i["name"]) if out is None else out.when(hit, i["name"])
    return utterances.withColumn("intent", out.otherwise("unknown") if out is not None else F.lit("unknown"))
