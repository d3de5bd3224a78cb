"""Learned transition probabilities: sampling, three classifiers, scoring of every cell, accuracy."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridError
from .accuracy import binary_change_accuracy

#: Starting points of the network.
RESTARTS = 5


def samples(cells: DataFrame, drivers: list[str], before: str = "before", after: str = "after", cap_changed: int = 5000, cap_same: int = 5000, seed: int = 42) -> DataFrame:
    """Capped sample per target class, changed and unchanged cells apart; unusable features go after the cap.

    The stratified cap is the feature itself. A hash of the cell orders the draw, and a coarse filter on it (taken from
    the strata's counts) leaves each stratum a few times its cap before anything is ranked.
    """
    if len(drivers) < 2:
        raise GridError("two drivers are needed")
    a, b = F.col(before), F.col(after)
    valid = cells.filter((a > 0) & (b > 0)).withColumn("label", b.cast("int")).withColumn("moved", (a != b).cast("int"))
    valid = valid.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "x", "y"), F.lit(1 << 40)))
    cap = F.when(F.col("moved") == 1, cap_changed).otherwise(cap_same)
    strata = valid.groupBy("label", "moved").agg(F.count("*").alias("n")).withColumn("limit", F.least(F.lit(1.0), 4.0 * cap / F.col("n") + 200.0 / F.col("n")) * float(1 << 40))
    drawn = valid.join(F.broadcast(strata.select("label", "moved", "limit")), ["label", "moved"]).filter(F.col("draw") < F.col("limit"))  # two rows a class
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("label", "moved").orderBy("draw", "x", "y"))).filter(F.col("rank") <= cap)
    usable = None
    for d in drivers:
        ok = F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double")) & (F.abs(F.col(d).cast("double")) != float("inf"))
        usable = ok if usable is None else usable & ok
    return ranked.filter(usable).select("x", "y", "label", "moved", *drivers)


def train(sample: DataFrame, drivers: list[str], method: str = "rf", trees: int = 60, rate: float = 0.6, seed: int = 42) -> tuple[PipelineModel, list[int]]:
    """(model, classes ascending). Methods: rf, ann (one hidden layer of max(5, drivers)), logit.

    The network is fitted from ``RESTARTS`` starting points and the one of least loss on the sample stays; MLlib's network
    has no weight decay.
    """
    classes = [r[0] for r in sample.select("label").distinct().orderBy("label").collect()]
    if len(classes) < 2:
        raise GridError("two classes are needed")
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    data = sample.withColumn("index", index.cast("double"))
    stages = [VectorAssembler(inputCols=drivers, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if method == "rf":
        stages.append(RandomForestClassifier(labelCol="index", numTrees=trees, subsamplingRate=rate, seed=seed, maxDepth=8))
    elif method == "ann":
        data = data.cache()  # at most two caps a class
        layers = [len(drivers), max(5, len(drivers)), len(classes)]
        loss = MulticlassClassificationEvaluator(labelCol="index", metricName="logLoss")
        fitted = [Pipeline(stages=[*stages, MultilayerPerceptronClassifier(labelCol="index", layers=layers, seed=seed + k, maxIter=100)]).fit(data) for k in range(RESTARTS)]
        best = min(fitted, key=lambda m: loss.evaluate(m.transform(data)))
        data.unpersist()
        return best, classes
    elif method == "logit":
        if data.limit(10).count() < 10:
            raise GridError("ten samples are needed")
        stages.append(LogisticRegression(labelCol="index", family="multinomial", regParam=1e-4))
    else:
        raise GridError(f"unknown method {method}")
    return Pipeline(stages=stages).fit(data), classes


def score(cells: DataFrame, model: PipelineModel, drivers: list[str], classes: list[int], value: str = "before") -> DataFrame:
    """(x, y, value, pg): probabilities in class order that sum to 1; all 0 where the class or a driver is missing or not finite."""
    valid = F.col(value) > 0
    for d in drivers:
        value_of = F.col(d).cast("double")
        valid = valid & F.col(d).isNotNull() & ~F.isnan(value_of) & (F.abs(value_of) != float("inf"))
    filled = cells.withColumn("ok", F.coalesce(valid, F.lit(False))).withColumns({d: F.when(F.col("ok"), F.col(d).cast("double")).otherwise(0.0) for d in drivers})
    p = vector_to_array("probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    zero = F.array(*[F.lit(0.0)] * len(classes))
    return model.transform(filled).select("x", "y", value, F.when(F.col("ok") & (total > 0), F.transform(p, lambda x: x / total)).otherwise(zero).alias("pg"))


def best_class(pg: DataFrame, classes: list[int]) -> DataFrame:
    """Adds ``best``: the first class of highest probability (NULL where all are 0)."""
    place = F.array_position("pg", F.array_max("pg"))
    return pg.withColumn("best", F.when(F.array_max("pg") > 0, F.element_at(F.array(*[F.lit(c) for c in classes]), place.cast("int"))))


def accuracy(pg: DataFrame, truth: DataFrame, classes: list[int], value: str = "before") -> DataFrame:
    """Change accuracy of the best classes against (x, y, real)."""
    return binary_change_accuracy(best_class(pg, classes).join(truth, ["x", "y"]), value, "best", "real")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
