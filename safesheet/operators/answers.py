"""Operators on models' answers and on the quality of extractions, written with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence_model
from ..functions.texts import CONTEXT_WORDS, context_score, json_from_text
from ..plans.domain import duckdb_query, spark_query
from ..plans.shared import written

#: Trees and depth of the forests.
TREES, DEPTH = 100, 10


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context score of each extraction, by its own value and its document's kind of sheet as phrases."""
    rows = spark_query(spark, sf_dir, "SELECT document_id, field_name, value FROM extractions WHERE value IS NOT NULL")
    return rows.select("document_id", "field_name", context_score(F.col("field_name"), F.array("value", F.lit("Hazard class of the product"))).alias("score"))


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of fenced answers made of every turn of the conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    head = F.concat(F.lit('{"role": "'), "role", F.lit('", "at": {"turn": '), F.col("turn").cast("string"), F.lit("}}"))
    return turns.select("conv_id", "turn", json_from_text(F.concat(F.lit("Sure.\n```json\n"), head, F.lit(" {}\n```\nDone {}"))).alias("found"))


def ml_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests that predict confidence (a row ``regression`` with its error) and validity (``classification`` with its share of
    right answers) of extractions from length, digits, case and field; a fifth by hash is held out. Equal rows are learnt and judged by their number. Without rows on either side: none."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    sql = """SELECT document_id, ord, CAST(length(value) AS DOUBLE) AS n_chars, CAST(MATCHES(value, '[0-9]') AS DOUBLE) AS has_digit, CAST(value = upper(value) AS DOUBLE) AS is_upper, CAST(ord AS DOUBLE) AS field,
        CAST(confidence AS DOUBLE) AS confidence, CAST(validation_status = 'valid' AS DOUBLE) AS valid FROM extractions WHERE value IS NOT NULL"""
    rows = spark_query(spark, sf_dir, sql).withColumn("part", F.pmod(F.xxhash64("document_id", "ord"), F.lit(5)))
    names = ["n_chars", "has_digit", "is_upper", "field"]
    kinds = written(confidence_model.weighted(rows.withColumn("held", F.col("part") == 0), ["document_id", "ord"], [*names, "confidence", "valid", "held"]), "examples")
    train, test = kinds.filter("not held"), kinds.filter("held")
    schema = "task string, n_test long, measure double, " + ", ".join(f"w_{n} double" for n in names)
    if train.isEmpty() or test.isEmpty():
        return spark.createDataFrame([], schema)
    regressor = RandomForestRegressor(labelCol="confidence", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=42)
    classifier = RandomForestClassifier(labelCol="valid", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=42)
    mean = lambda c: F.sum(c * F.col("weight")) / F.sum("weight")
    made = []
    for task, forest, measure in (("regression", regressor, F.sqrt(mean((F.col("prediction") - F.col("confidence")) ** 2))), ("classification", classifier, mean((F.col("prediction") == F.col("valid")).cast("double")))):
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(train)
        n, m = model.transform(test).agg(F.sum("weight").cast("long"), measure).first()
        made.append((task, n, m, *(float(w) for w in model.stages[1].featureImportances.toArray())))
    return spark.createDataFrame(made, schema)


QUERIES = {"context_score": context_scores, "json_from_text": json_answers, "ml_train": ml_train}
_WORDS = ", ".join(f"('{f}', {ws})" for f, ws in CONTEXT_WORDS.items())
#: A forest has no SQL: it is tested by what it holds out.
SQL = {
    "context_score": duckdb_query(f"""SELECT document_id, field_name, CASE WHEN words IS NULL THEN 0.75E0 WHEN hits = 0 THEN 0.6E0 WHEN hits = 1 THEN 0.8E0 ELSE 0.95E0 END AS score FROM (
        SELECT e.document_id, e.field_name, w.words, len([x for x in w.words if contains(lower(e.value), x)]) + len([x for x in w.words if contains('hazard class of the product', x)]) AS hits
        FROM extractions e LEFT JOIN (VALUES {_WORDS}) AS w(field_name, words) ON w.field_name = e.field_name WHERE e.value IS NOT NULL) x"""),
    "json_from_text": """SELECT conv_id, turn, concat('{"role": "', role, '", "at": {"turn": ', CAST(turn AS VARCHAR), '}}') AS found FROM conversations""",
}
