"""Queries over sources, logs and features, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs
from ..plans.domain import duckdb_query, spark_query
from ..sources import jsonl


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _outcomes(spark: SparkSession, sf_dir: str, bad: int, lacking: int, fields: tuple[str, str], schema: str, required: list[str], missing: str) -> DataFrame:
    """Outcomes of a line for each event: some are cut off, some lack their last field."""
    a, b = fields
    line = F.when(F.col("event_id") % bad == 0, F.concat(F.lit("{"), "event_type")).otherwise(F.to_json(F.struct(F.col("event_type").alias(a), F.when(F.col("event_id") % lacking != 0, F.col("props")).alias(b), F.lit("I").alias("rule"))))
    lines = _events(spark, sf_dir).select(line.alias("line"), F.lit("events").alias("file"), F.col("event_id").alias("at"))
    return jsonl.parse_lines(lines, schema, required, missing).groupBy("outcome").agg(F.count("*").alias("n"))


def rules_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, 13, 7, ("cas_a", "cas_b"), jsonl.RULE, ["cas_a", "cas_b", "rule"], "missing_fields")


def hazards_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, 11, 9, ("source", "cas"), jsonl.HAZARD, ["cas"], "missing_cas")


def _outcomes_sql(bad: int, lacking: int, missing: str) -> str:
    return f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % {bad} = 0 THEN 'invalid_json' WHEN event_id % {lacking} = 0 OR props IS NULL OR trim(props) = '' THEN '{missing}'
        WHEN row_number() OVER (PARTITION BY event_type, props, event_id % {bad} = 0 OR event_id % {lacking} = 0 ORDER BY event_id) > 1 THEN 'duplicate_hash' ELSE 'processed' END AS outcome FROM events) x GROUP BY outcome"""


ALLOWED = ["example.com", "Therin.example.net"]


def domain_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return pages.filter(jsonl.allowed(url, ALLOWED)).select("page_id")


DOMAIN_SQL = r"""SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) p WHERE host IN ('example.com', 'therin.example.net') OR ends_with(host, '.example.com') OR ends_with(host, '.therin.example.net')"""


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a log with a line for each event, by kind."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    line = (
        F.when(k % 10 == 0, F.concat(F.lit("INFO Processing letter '"), F.chr(65 + F.col("user_id") % 26), F.lit("'"))).when(k % 10 == 1, F.concat(F.lit("Found "), text(F.col("user_id")), F.lit(" unique chemicals for letter 'A'")))
        .when(k % 10 < 6, F.concat(F.lit("✓ Ingested: x (ID: "), text(k), F.lit(", 3 chunks)"))).when(k % 10 == 7, F.lit("Failed to scrape y")).otherwise("other")
    )
    return logs.log_stats(_events(spark, sf_dir).select(line.alias("line"))).withColumn("letters", F.array_join("letters", ""))


LOG_SQL = """SELECT CAST(coalesce(sum(CASE WHEN event_id % 10 = 1 THEN user_id END), 0) AS BIGINT) AS total_found, count(*) FILTER (WHERE event_id % 10 BETWEEN 2 AND 5) AS total_ingested, count(*) FILTER (WHERE event_id % 10 = 7) AS total_failed,
    coalesce(array_to_string(list_sort(list(DISTINCT chr(CAST(65 + user_id % 26 AS INT))) FILTER (WHERE event_id % 10 = 0)), ''), '') AS letters FROM events"""


def query_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("query_id"), F.transform(ids, lambda k: k * 10).alias("document_ids"), ids.alias("chunks"), F.col("value").alias("top_score"))
    return logs.ranked_results(rows)


RANKS_SQL = "SELECT event_id AS query_id, rank * 10 AS document_id, rank AS chunk_index, CASE WHEN rank = 1 THEN value END AS relevance_score, rank FROM (SELECT event_id, value, unnest(range(1, event_id % 4 + 2)) AS rank FROM events) x"


def tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.concat(F.lit('{"Information": [{"Name": "H'), (F.col("event_id") % 200 + 200).cast("string"), F.lit('"}, {"Name": "Hx"}], "Node": [{"Node": [{"Information": [{"Name" : "H319"}, {"Name": "P280"}]}]}, {"Label": "H300"}]}'))
    return _events(spark, sf_dir).select("event_id", F.array_join(logs.tree_codes(tree), ",").alias("codes"))


TREE_SQL = "SELECT event_id, concat('H', CAST(event_id % 200 + 200 AS VARCHAR), ',H319') AS codes FROM events"


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, field_name, value, concat('A Hazard class of ', value) AS context, CASE document_id % 3 WHEN 0 THEN 'Heuristic' WHEN 1 THEN 'llm' ELSE 'rag' END AS source FROM extractions WHERE value IS NOT NULL")
    c = F.col
    return rows.select("document_id", "field_name", *logs.features(c("field_name"), c("value"), c("context"), c("source"), F.lit(0.8), c("document_id") % 3))


def _feature_sql() -> str:
    flag = lambda s: f"CAST(({s}) AS INT)"
    place = lambda w: f"CASE WHEN strpos(near, {w}) > 0 THEN strpos(near, {w}) - 1 END"
    far = "CASE field_name " + " ".join(f"WHEN '{f}' THEN least({', '.join(place(repr(w)) for w in ws)}, {logs.FAR})" for f, ws in logs.LABELS.items()) + f" ELSE least({place("replace(field_name, '_', ' ')")}, {logs.FAR}) END"
    own = ["contains(field_name, 'cas')", "contains(field_name, 'product') OR contains(field_name, 'name')", "contains(field_name, 'hazard')"]
    values = ["0.8E0", "length(value)", flag("regexp_matches(value, '[]!@#$%^&*(){}|/<>[]')"), flag("regexp_matches(value, '[0-9]')"), flag("regexp_matches(value, '[A-Z]')"), " + ".join(flag(f"contains(near, '{w}')") for w in logs.NEAR_WORDS), "length(near)", far,
              flag("document_id % 3 = 0"), flag("document_id % 3 = 1"), flag("document_id % 3 = 2"), *map(flag, own), flag(f"NOT ({' OR '.join(own)})"), flag("document_id % 3 > 0"), "document_id % 3"]
    made = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for v, n in zip(values, logs.FEATURES, strict=True))
    return f"SELECT document_id, field_name, {made} FROM (SELECT *, lower(concat('A Hazard class of ', value)) AS near FROM extractions WHERE value IS NOT NULL) e"


QUERIES = {"ingest_rules_outcomes": rules_outcomes, "ingest_hazards_outcomes": hazards_outcomes, "domain_allowed": domain_allowed, "log_stats": log_stats, "query_ranks": query_ranks, "tree_codes": tree_codes, "ml_features": ml_features}
SQL = {k: duckdb_query(v) for k, v in {
    "ingest_rules_outcomes": _outcomes_sql(13, 7, "missing_fields"), "ingest_hazards_outcomes": _outcomes_sql(11, 9, "missing_cas"), "domain_allowed": DOMAIN_SQL, "log_stats": LOG_SQL, "query_ranks": RANKS_SQL, "tree_codes": TREE_SQL, "ml_features": _feature_sql(),
}.items()}
