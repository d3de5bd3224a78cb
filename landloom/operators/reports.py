"""The nine checks of a finished report, over frames of reports and of what they were made from.

Frames: ``reports`` (report_id, template, content, title, period), ``indicators`` (report_id, code, name, value as text, unit,
nodata_handled), ``charts`` (report_id, chart_id, path) and ``files`` (path), the files that exist. A report whose content is
null was not found: it fails rule 9 and no other is judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chapters that a template must have, the placeholder of a chart, marks of a failed rendering.
CHAPTERS = {"composite": ["执行摘要", "指标总览", "结论"], "trend": ["趋势概述", "时间序列分析", "结论"], "subregion": ["区域概述", "区域指标", "建议"]}
PLACEHOLDER = "[图表占位]"
LEFTOVERS = r"\{\{.*\}\}|\{%.*%\}|UndefinedError|TemplateNotFound|TypeError:.*NoneType"
SCORE_RANGE = (0, 100)


def checks(reports: DataFrame, indicators: DataFrame, charts: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """(report_id, rule_id, severity) for every report and rule; ``strict`` turns warnings into failures."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    number = F.col("value").try_cast("double")
    scored = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("score")) | F.contains(F.lower(F.coalesce("code", F.lit(""))), F.lit("score"))
    wrong = F.col("value").isNotNull() & (number.isNull() | (scored & ~number.between(*SCORE_RANGE)))
    by_indicator = indicators.groupBy("report_id").agg(
        F.count("*").alias("n_indicators"), F.count_if(wrong).alias("n_wrong"), F.count_if(blank("unit")).alias("n_unitless"), F.max(F.coalesce("nodata_handled", F.lit(False))).alias("nodata")
    )
    there = files.select(F.col("path").alias("f_path")).distinct()
    said = reports.select("report_id", "content")
    known = charts.join(there, F.col("path") == F.col("f_path"), "left").join(said, "report_id")
    shown = F.contains("content", F.col("chart_id")) | F.when(~blank("path"), F.contains("content", F.element_at(F.split("path", "/"), -1))).otherwise(False)
    by_chart = known.groupBy("report_id").agg(F.count("*").alias("n_charts"), F.count_if(~blank("path") & F.col("f_path").isNull()).alias("n_missing"), F.count_if(~shown).alias("n_unshown"))
    r = reports.join(by_indicator, "report_id", "left").join(by_chart, "report_id", "left").fillna(0, ["n_indicators", "n_wrong", "n_unitless", "n_charts", "n_missing", "n_unshown"])
    lacking = F.lit(False)
    for template, chapters in CHAPTERS.items():
        whole = F.lit(True)
        for c in chapters:
            whole = whole & F.contains("content", F.lit(c))
        lacking = lacking | ((F.col("template") == template) & ~whole)

    def rule(k, fail=None, warn=None):
        severity = F.lit("PASS") if warn is None else F.when(warn, "FAIL" if strict else "WARN").otherwise("PASS")
        return F.struct(F.lit(k).alias("rule_id"), (severity if fail is None else F.when(fail, "FAIL").otherwise(severity)).alias("severity"))

    held = F.contains("content", F.lit(PLACEHOLDER))
    rules = F.array(
        rule(1, fail=blank("title") | blank("period")),
        rule(2, warn=(F.col("n_indicators") == 0) | (F.col("n_wrong") > 0)),
        rule(3, fail=(F.col("n_missing") > 0) & ~held, warn=(F.col("n_missing") > 0) & held),
        rule(4, fail=F.coalesce(lacking, F.lit(False))),
        rule(5, warn=F.col("n_unshown") > 0),
        rule(6, warn=F.col("n_unitless") > 0),
        rule(7, warn=F.coalesce("nodata", F.lit(False)) & ~F.contains(F.lower("content"), F.lit("nodata"))),
        rule(8, fail=F.rlike("content", F.lit(LEFTOVERS))),
        rule(9, fail=F.trim("content") == ""),
    )
    return r.select("report_id", F.inline(F.when(F.col("content").isNotNull(), rules).otherwise(F.array(rule(9, fail=F.lit(True))))))


def verdicts(found: DataFrame) -> DataFrame:
    """Overall severity per report: the highest of its rules."""
    rank = F.when(F.col("severity") == "FAIL", 2).when(F.col("severity") == "WARN", 1).otherwise(0)
    return found.groupBy("report_id").agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.max(rank) + 1).alias("overall"))
