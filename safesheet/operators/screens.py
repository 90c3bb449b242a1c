"""Queries over screened texts, mixtures, wide rows, missing fields and confidence, and oracles written apart from the functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence_model, enrichment, knowledge_graph, matrix, mixtures, screening, wide
from ..plans.domain import duckdb_query, rules_among, spark_query
from ..plans.shared import written
from .ingest import SQL as INGEST_SQL
from .ingest import ml_features

_LIST = """CASE document_id % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Avoid acids (all), Strong Bases; water' WHEN 2 THEN concat('Incompatible with oxidizers/', product_name) WHEN 3 THEN 'acids, bases'
    WHEN 4 THEN 'Based on the given context: avoid it' WHEN 5 THEN concat('reacts with a1b1, a2b2, a3b3, a4b4, a5b5, a6b6, a7b7, a8b8, a9b9, b1c1, b2c2, ', p_brand) ELSE '' END"""


def screened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, f"SELECT document_id, {_LIST} AS text FROM chem")
    return screening.incompatible_names(rows).select("document_id", F.col("nth").cast("long").alias("nth"), "name")


NAMES_SQL = """SELECT document_id, nth, name FROM (
    SELECT document_id, 1 AS nth, 'avoid acids' AS name FROM chem WHERE document_id % 7 = 1 UNION ALL SELECT document_id, 2, 'strong bases' FROM chem WHERE document_id % 7 = 1 UNION ALL SELECT document_id, 3, 'water' FROM chem WHERE document_id % 7 = 1
    UNION ALL SELECT document_id, 1, 'incompatible with oxidizers' FROM chem WHERE document_id % 7 = 2 UNION ALL SELECT document_id, 2, lower(product_name) FROM chem WHERE document_id % 7 = 2 AND length(product_name) > 3
    UNION ALL SELECT document_id, k + 1, CASE k WHEN 0 THEN 'reacts with a1b1' WHEN 9 THEN 'b1c1' ELSE concat('a', k + 1, 'b', k + 1) END FROM chem, range(10) AS r(k) WHERE document_id % 7 = 5) x"""

_SHEET = """concat(substr(text, 1, 300), CASE doc_id % 5 WHEN 0 THEN ' Gefahr Hersteller' WHEN 1 THEN ' Numero CAS, Fabricante, Emergencia' WHEN 2 THEN ' HAZARD' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN ' Merck KGaA' WHEN 1 THEN ' thermo fisher and Avantor' ELSE '' END)"""


def sheet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by key words and maker's profile of sheets that end in some words."""
    rows = spark_query(spark, sf_dir, f"SELECT doc_id, {_SHEET} AS sheet FROM documents")
    said = screening.language_by_words(F.col("sheet"))
    return rows.select("doc_id", said["lang"].alias("lang"), F.round(said["confidence"], 6).alias("confidence"), screening.maker_profile(F.col("sheet")).alias("profile"))


def _kinds_sql() -> str:
    hits = ", ".join(f"({' + '.join(f'CAST(contains(low, {w!r}) AS INT)' for w in words)}) AS {lang}" for lang, words in screening.LANGUAGE_WORDS.items())
    langs = list(screening.LANGUAGE_WORDS)
    top = f"greatest({', '.join(langs)})"
    pick = "CASE " + " ".join(f"WHEN {x} = {top} THEN '{x}'" for x in langs) + " END"
    return f"""SELECT doc_id, CASE WHEN {top} > 0 THEN {pick} ELSE 'unknown' END AS lang, round(least(1.0E0, {top} / 2.4E0), 6) AS confidence,
        CASE WHEN contains(low, 'merck') THEN 'Sigma-Aldrich' WHEN contains(low, 'thermo fisher') THEN 'Fisher Scientific' WHEN contains(low, 'avantor') THEN 'VWR' ELSE 'Generic' END AS profile
        FROM (SELECT doc_id, low, {hits} FROM (SELECT doc_id, lower({_SHEET}) AS low FROM documents) d) x"""


_CLASSIFIED = """SELECT replace(cas, '-', '') AS cas_number, code AS hazard_code, category, kind AS hazard_class, concat('s', code) AS statement, source, confidence FROM hazards
    JOIN (VALUES ('H225', '2', 'flammable', 'ECHA', 0.95E0), ('H225', '2', 'flammable', 'PubChem', 0.85E0), ('H300', '2', 'toxic', 'ECHA', 0.95E0), ('H314', '1B', 'corrosive', 'PubChem', 0.85E0), ('H999', '1', 'toxic', 'ECHA', 0.95E0)) AS t(code, category, kind, source, confidence)
    ON kind = 'flammable' AND flammable OR kind = 'toxic' AND toxic OR kind = 'corrosive' AND corrosive"""
_PARTS = "SELECT document_id, l_orderkey * 10 + line_no AS line_no, cas_number, chemical_name AS name, round(concentration_max, 4) AS max_concentration FROM ingredients"


def mixture_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mixtures have of their components' hazards by the thresholds of codes and categories."""
    found = mixtures.mixture_hazards(spark_query(spark, sf_dir, _PARTS), spark_query(spark, sf_dir, _CLASSIFIED))
    return found.select("document_id", "hazard_code", "category", "hazard_class", "source", "confidence")


MIXTURE_SQL = f"""WITH p AS ({_PARTS}), c AS ({_CLASSIFIED}) SELECT document_id, hazard_code, category, hazard_class, concat('Calculated from ', name) AS source, 0.9E0 AS confidence FROM (
    SELECT p.document_id, c.hazard_code, c.category, c.hazard_class, p.name, row_number() OVER (PARTITION BY p.document_id, c.hazard_code, c.category ORDER BY p.line_no, c.confidence DESC, c.source) AS k
    FROM p JOIN c ON replace(p.cas_number, '-', '') = c.cas_number WHERE p.max_concentration >= CASE c.hazard_code WHEN 'H225' THEN 10 WHEN 'H300' THEN 1 WHEN 'H314' THEN 5 ELSE 100 END AND p.max_concentration > 0) x WHERE k = 1"""

_META = """CASE document_id % 4 WHEN 0 THEN '{"quality_tier": "good", "external_validation": {"is_valid": true}}' WHEN 1 THEN '{"external_validation": {"is_valid": false}}' WHEN 2 THEN 'no json' END"""


def wide_tiers(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """All documents in wide rows with the tiers of their names' metadata; without the page's limit."""
    documents = spark_query(spark, sf_dir, "SELECT *, processing_seconds AS processing_time_seconds FROM sds_documents")
    extractions = spark_query(spark, sf_dir, f"SELECT document_id, field_name, value, confidence, {_META} AS metadata FROM extractions WHERE document_id % 29 <> 0")
    return wide.wide_results(documents, extractions, limit).select("id", "status", "product_name", "cas_number", "incompatibilities", "completeness", F.round("avg_confidence", 6).alias("avg_confidence"), "quality_tier", "validated")


WIDE_SQL = """SELECT d.id, d.status, e.product_name, e.cas_number, e.incompatibilities, coalesce(d.completeness_score, 0) AS completeness, round(coalesce(d.avg_confidence, e.mean), 6) AS avg_confidence,
    CASE WHEN e.product_name IS NOT NULL AND d.id % 4 = 0 THEN 'good' ELSE 'unknown' END AS quality_tier, e.product_name IS NOT NULL AND d.id % 4 = 0 AS validated FROM sds_documents d LEFT JOIN (
    SELECT document_id, max(value) FILTER (WHERE field_name = 'product_name') AS product_name, max(value) FILTER (WHERE field_name = 'cas_number') AS cas_number, max(value) FILTER (WHERE field_name = 'incompatibilities') AS incompatibilities, avg(confidence) AS mean
    FROM extractions WHERE document_id % 29 <> 0 GROUP BY document_id) e ON e.document_id = d.id WHERE d.status IN ('success', 'failed', 'partial')"""

_EXTENDED = f"SELECT document_id, CASE p_size % 6 WHEN 0 THEN 'flash_point' WHEN 1 THEN 'ph' WHEN 2 THEN 'signal_word' WHEN 3 THEN 'un_number' ELSE 'sara_313' END AS field_name, CASE WHEN document_id % 5 = 0 THEN 'NOT_FOUND' WHEN document_id % 7 = 0 THEN NULL ELSE 'x' END AS value FROM chem"


def extended_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.field_gaps(spark_query(spark, sf_dir, _EXTENDED))


GAPS_SQL = f"""WITH e AS ({_EXTENDED}) SELECT f AS field_name, count(e.value) AS filled, count(DISTINCT e.document_id) AS documents, CASE WHEN count(e.document_id) = 0 THEN 'none' WHEN count(DISTINCT e.document_id) < (SELECT count(DISTINCT document_id) FROM e) THEN 'partial' ELSE 'full' END AS status
    FROM (SELECT unnest({wide.EXTENDED}) AS f) n LEFT JOIN e ON e.field_name = f AND e.value IS NOT NULL AND e.value <> 'NOT_FOUND' GROUP BY f"""


def rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by rule of the extractions' features."""
    return confidence_model.by_rule(ml_features(spark, sf_dir)).select("document_id", "field_name", F.round("confidence", 6).alias("confidence"), "quality_tier", "is_high_quality")


def _rule_sql() -> str:
    score = "least(1.0E0, 0.5E0 + 0.2E0 * pattern_match_strength + CASE WHEN source_heuristic > 0 THEN 0.1E0 ELSE 0 END + CASE WHEN cross_fields_count > 0 THEN 0.08E0 ELSE 0 END + CASE WHEN context_keyword_count > 0 THEN 0.05E0 ELSE 0 END)"
    return f"""SELECT document_id, field_name, round(score, 6) AS confidence, CASE WHEN round(score, 9) >= 0.75 THEN 'good' WHEN round(score, 9) >= 0.6 THEN 'acceptable' ELSE 'poor' END AS quality_tier, round(score, 9) >= 0.75 AS is_high_quality
        FROM (SELECT *, {score} AS score FROM ({INGEST_SQL['ml_features']}) f) x"""


def forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forests over the 17 features are worth on the extractions that they didn't see: (measure, value), and each feature's share; no rows if there are too few."""
    said = spark_query(spark, sf_dir, "SELECT document_id, field_name, confidence, CASE validation_status WHEN 'valid' THEN 'good' WHEN 'warning' THEN 'acceptable' ELSE 'poor' END AS tier FROM extractions WHERE value IS NOT NULL")
    examples = ml_features(spark, sf_dir).join(said, ["document_id", "field_name"])
    try:
        model = confidence_model.train(examples, ["document_id", "field_name"])
    except confidence_model.TooFew:  # no other error is an empty result
        return spark.createDataFrame([], "measure string, value double")
    return spark.createDataFrame([*model.metrics.items(), *((f"share_{n}", x) for n, x in model.importances)], "measure string, value double")


def hazardous_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules I and R between the chemicals of the ingredients; only their lines are paired."""
    held = spark_query(spark, sf_dir, "SELECT DISTINCT cas_number AS cas FROM ingredients")
    return matrix.hazardous_combinations(rules_among(spark, sf_dir, held), held.withColumnRenamed("cas", "cas_number"))


HAZARDOUS_SQL = "SELECT r.cas_a, r.cas_b, r.rule FROM rules r WHERE r.rule IN ('I', 'R') AND r.cas_a IN (SELECT cas_number FROM ingredients) AND r.cas_b IN (SELECT cas_number FROM ingredients)"

QUERIES = {
    "screened_names": screened_names, "sheet_kinds": sheet_kinds, "mixture_classified": mixture_classified, "wide_tiers": wide_tiers, "extended_gaps": extended_gaps, "rule_confidence": rule_confidence,
    "forest_metrics": forest_metrics, "hazardous_combinations": hazardous_combinations,
}
SQL = {
    "screened_names": duckdb_query(NAMES_SQL), "sheet_kinds": _kinds_sql(), "mixture_classified": duckdb_query(MIXTURE_SQL), "wide_tiers": duckdb_query(WIDE_SQL), "extended_gaps": duckdb_query(GAPS_SQL),
    "rule_confidence": _rule_sql(), "hazardous_combinations": duckdb_query(HAZARDOUS_SQL),
}

_OWN = """SELECT document_id, CASE WHEN document_id % 3 = 0 THEN NULL WHEN document_id % 5 = 0 THEN concat(cas, 'x') ELSE cas END AS cas_number, CASE document_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'c2 h6o' WHEN 2 THEN 'CH4' ELSE 'C2H6O' END AS molecular_formula,
    CAST(p_size AS STRING) AS molecular_weight, CASE WHEN p_size % 2 = 0 THEN 'H225,H319' ELSE 'H225' END AS h_statements, CAST(NULL AS STRING) AS p_statements, product_name, (document_id % 10) / 10.0E0 AS mean_confidence FROM chem"""


def enrichment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chemicals as documents with some values changed, compared with their properties."""
    own = spark_query(spark, sf_dir, "SELECT document_id, cas AS cas_number, product_name, p_size FROM chem")
    properties = own.select(
        "document_id", "cas_number", F.lit("C2H6O").alias("molecular_formula"), F.lit(None).cast("string").alias("iupac_name"), F.when(F.col("p_size") % 7 == 0, "about 46").otherwise("46.069").alias("molecular_weight"),
        F.lit("CCO").alias("canonical_smiles"), F.lit("").alias("inchi_key"), F.array(F.lit("H319"), F.lit("H225")).alias("hazard_statements"), F.array(F.lit("P210")).alias("precautionary_statements"), F.array().cast("array<string>").alias("pictograms"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.upper("product_name"))).otherwise(F.array(F.lit("zz"))).alias("synonyms"), F.lit(None).cast("string").alias("url"),
    )
    return enrichment.compare(spark_query(spark, sf_dir, _OWN), properties).select("document_id", "field_name", "enriched", "confidence", "status")


FINDINGS_SQL = f"""WITH d AS (SELECT o.*, c.cas, c.p_size FROM ({_OWN}) o JOIN chem c ON c.document_id = o.document_id WHERE o.mean_confidence < 0.8)
    SELECT document_id, 'cas_number' AS field_name, cas AS enriched, CASE WHEN cas_number IS NULL THEN 0.85E0 ELSE 0.6E0 END AS confidence, CASE WHEN cas_number IS NULL THEN 'enriched' ELSE 'warning' END AS status FROM d WHERE cas_number IS NULL OR cas_number <> cas
    UNION ALL SELECT document_id, 'molecular_formula', 'C2H6O', CASE WHEN molecular_formula = '' THEN 0.9E0 ELSE 0.65E0 END, CASE WHEN molecular_formula = '' THEN 'enriched' ELSE 'warning' END FROM d WHERE molecular_formula IN ('', 'CH4')
    UNION ALL SELECT document_id, 'molecular_weight', CASE WHEN p_size % 7 = 0 THEN 'about 46' ELSE '46.07 g/mol' END, CASE WHEN p_size % 7 = 0 THEN 0.8E0 ELSE 0.95E0 END, 'enriched' FROM d UNION ALL SELECT document_id, 'canonical_smiles', 'CCO', 0.95E0, 'enriched' FROM d
    UNION ALL SELECT document_id, 'h_statements', 'H225, H319', 0.8E0, 'enriched' FROM d WHERE p_size % 2 <> 0 UNION ALL SELECT document_id, 'p_statements', 'P210', 0.8E0, 'enriched' FROM d UNION ALL SELECT document_id, 'product_name', NULL, 0.5E0, 'warning' FROM d WHERE p_size % 2 <> 0"""
QUERIES["enrichment_findings"] = enrichment_findings
SQL["enrichment_findings"] = duckdb_query(FINDINGS_SQL)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = lambda sql: spark_query(spark, sf_dir, sql)
    codes = knowledge_graph.code_tables(q("SELECT document_id, field_name, value FROM extractions"))
    rules = q("SELECT cas_a, cas_b, rule, source, 'a' AS group_a, 'b' AS group_b, NULL AS justification FROM rules")
    makers = q("SELECT DISTINCT cas, manufacturer FROM cas_maker")
    similar = q("SELECT a.cas AS cas_a, a.cas AS cas_b, 0.8E0 AS score, 'profile' AS kind FROM hazards a WHERE a.env_risk")
    edges = written(knowledge_graph.graph_edges(rules, makers, None, similar), "edges")
    products = q("SELECT document_id, cas_number AS cas, product_name, manufacturer AS supplier, avg_confidence AS confidence, hazard_class FROM wide WHERE cas_number NOT IN ('NOT_FOUND', 'N/A')")
    hazards = q("SELECT cas, hazard_flags, env_risk, idlh, pel, CAST(NULL AS DOUBLE) AS rel FROM hazards")
    return knowledge_graph.graph_nodes(edges, products, hazards, codes["classes"], codes["p_codes"].select("cas", "p_code")), edges


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the graph of all loaders."""
    nodes, edges = _graph(spark, sf_dir)
    found = knowledge_graph.graph_stats(nodes, edges)
    return found.withColumns({"avg_degree": F.round("avg_degree", 6), "density": F.round("density", 9)})


_NUMBERED = "(SELECT document_id, max(value) FILTER (WHERE field_name = 'cas_number') AS cas, max(value) FILTER (WHERE field_name = 'hazard_class') AS k, max(value) FILTER (WHERE field_name = 'p_statements') AS p FROM extractions GROUP BY document_id)"
SUMMARY_SQL = f"""WITH e AS (SELECT cas_a AS a, cas_b AS b, 'i' AS kind FROM rules UNION ALL SELECT cas_b, cas_a, 'i' FROM rules UNION ALL SELECT DISTINCT cas, concat('mfg:', manufacturer), 'm' FROM cas_maker WHERE manufacturer IS NOT NULL
    UNION ALL SELECT cas, cas, 's' FROM hazards, range(2) AS r(k) WHERE env_risk), s AS (SELECT * FROM {_NUMBERED} x WHERE cas NOT IN ('', 'NOT_FOUND', 'N/A')),
    n AS (SELECT a AS id FROM e UNION SELECT b FROM e UNION SELECT cas FROM hazards UNION SELECT cas FROM s WHERE k <> '' OR p IS NOT NULL UNION SELECT cas_number FROM wide WHERE cas_number NOT IN ('NOT_FOUND', 'N/A')),
    f AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n WHERE NOT starts_with(id, 'mfg:')) AS chemicals, (SELECT count(DISTINCT cas) FROM s WHERE k <> '' AND k NOT IN ('NOT_FOUND', 'N/A')) AS with_hazards,
    (SELECT count(DISTINCT cas) FROM s WHERE regexp_matches(p, 'P(1[0-9][0-9]|[2-4][0-9][0-9]|50[0-9]|510)')) AS with_p_statements, (SELECT count(DISTINCT a) FROM e WHERE kind = 's') AS with_similarity)
    SELECT nodes, edges, chemicals, nodes - chemicals AS manufacturers, round(2.0E0 * edges / nodes, 6) AS avg_degree, round(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 9) AS density, with_hazards, with_p_statements, with_similarity,
    concat(with_hazards, '/', chemicals) AS hazards_coverage, concat(with_p_statements, '/', chemicals) AS p_statements_coverage, concat(with_similarity, '/', chemicals) AS similarity_coverage FROM f"""
QUERIES["graph_summary"] = graph_summary
SQL["graph_summary"] = duckdb_query(SUMMARY_SQL)
