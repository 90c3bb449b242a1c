"""Confidence of extractions by forests over the 17 features, and by rule without a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .logs import FEATURES

# Trees, their depth, share held out, seed, least examples; tiers that count as high; bounds of the tiers; weights of the rule.
TREES, DEPTH, HELD_OUT, SEED, LEAST = 100, 10, 5, 42, 10
HIGH = ["excellent", "good"]
#: Rows at most that equal examples are kept as, with their numbers as weights: as many draws of a tree's sample fall on them.
PIECES = 16
TIERS = [(0.85, "excellent"), (0.75, "good"), (0.60, "acceptable"), (0.40, "poor")]
RULE_BASE, RULE = 0.5, {"pattern_match_strength": 0.2, "source_heuristic": 0.1, "has_cross_validation": 0.08, "context_keyword_count": 0.05}
RULE_TIERS = [(0.75, "good"), (0.60, "acceptable")]


class TooFew(ValueError):
    """There are too few examples to train and test on."""


@dataclass
class Model:
    regressor: PipelineModel
    classifier: PipelineModel
    #: (train_size, test_size, mse, rmse, r2, accuracy, f1) of what was held out.
    metrics: dict[str, float]
    #: Share of each feature in the regressor, most first.
    importances: list[tuple[str, float]]


def _tier(score: Column, bounds: list[tuple[float, str]], else_: str) -> Column:
    out = F.when(score >= bounds[0][0], bounds[0][1])
    for least, name in bounds[1:]:
        out = out.when(score >= least, name)
    return out.otherwise(else_)


def weighted(rows: DataFrame, key: list[str], columns: list[str], pieces: int = PIECES) -> DataFrame:
    """(``columns``, weight): the rows with equal ``columns`` as ``pieces`` rows at most, parted by the hash of ``key``; the weights are their numbers, so that every row counts."""
    piece = F.pmod(F.xxhash64(*key, F.lit("piece")), F.lit(pieces))
    return rows.groupBy(*columns, piece.alias("__piece")).agg(F.count("*").cast("double").alias("weight")).drop("__piece")


def train(examples: DataFrame, key: list[str], features: list[str] = FEATURES) -> Model:
    """Forests for confidence and for a high tier of ``examples`` (``key``, ``features``, confidence, tier), with their errors on a fifth held out by the hash of ``key``. Rows with a
    null in any of these don't count; fewer than LEAST examples are an error, as is nothing on one side. Equal examples are learnt and judged by their number (``weighted``)."""
    rows = examples.dropna(subset=[*key, *features, "confidence", "tier"]).withColumn("high", F.col("tier").isin(*HIGH).cast("double")).withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(HELD_OUT)))
    kinds = written(weighted(rows.withColumn("__held", F.col("__part") == 0), key, [*features, "confidence", "high", "__held"]), "examples")
    learn, held = kinds.filter("not __held"), kinds.filter("__held")
    n, m = (int(side.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]) for side in (learn, held))
    if n + m < LEAST or not n or not m:
        raise TooFew(f"{n + m} examples are too few to train and test on")
    gathered = VectorAssembler(inputCols=features, outputCol="__features")
    fit = lambda forest: PipelineModel([gathered, forest.fit(gathered.transform(learn))])
    regressor = fit(RandomForestRegressor(featuresCol="__features", labelCol="confidence", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED))
    classifier = fit(RandomForestClassifier(featuresCol="__features", labelCol="high", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED))
    said, told = regressor.transform(held), classifier.transform(held)
    metrics = {"train_size": float(n), "test_size": float(m)}
    metrics |= {name: RegressionEvaluator(labelCol="confidence", weightCol="weight", metricName=name).evaluate(said) for name in ("mse", "rmse", "r2")}
    metrics["accuracy"] = MulticlassClassificationEvaluator(labelCol="high", weightCol="weight", metricName="accuracy").evaluate(told)
    metrics["f1"] = MulticlassClassificationEvaluator(labelCol="high", weightCol="weight", metricName="fMeasureByLabel", metricLabel=1.0).evaluate(told)
    shares = zip(features, map(float, regressor.stages[1].featureImportances.toArray()), strict=True)
    return Model(regressor, classifier, metrics, sorted(shares, key=lambda x: (-x[1], x[0])))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` with confidence (0 to 1), quality_tier, is_high_quality and high_quality_probability; rows with a null feature are an error of the assembler."""
    columns = [c for c in rows.columns if c not in ("confidence", "quality_tier", "is_high_quality", "high_quality_probability")]
    said = model.regressor.transform(rows.select(*columns)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction", "__features")
    told = model.classifier.transform(said)
    return told.select(*columns, "confidence", _tier(F.col("confidence"), TIERS, "unreliable").alias("quality_tier"), (F.col("prediction") == 1).alias("is_high_quality"), F.get(vector_to_array("probability"), F.lit(1)).alias("high_quality_probability"))


def by_rule(rows: DataFrame) -> DataFrame:
    """As ``predict`` without a model: a base and weights of four features; the number of context words counts as any or none."""
    score = F.lit(RULE_BASE)
    for name, weight in RULE.items():
        score = score + weight * (F.col(name) if name == "pattern_match_strength" else (F.col(name) > 0).cast("double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in ("confidence", "quality_tier", "is_high_quality", "high_quality_probability")]
    return rows.select(*columns, score.alias("confidence"), _tier(score, RULE_TIERS, "poor").alias("quality_tier"), (score >= RULE_TIERS[0][0]).alias("is_high_quality"), score.alias("high_quality_probability"))
