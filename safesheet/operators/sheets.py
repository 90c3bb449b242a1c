"""Queries that call the library's functions on frames, and their oracles, which are SQL of their own over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks, matrix, names, tables, walks
from ..functions.answers import normal_answer
from ..functions.fields import BASE_CONFIDENCE, DANGEROUS, base_confidence, extract_fields, is_dangerous
from ..functions.sheets import ingredients, sections
from ..plans.domain import duckdb_query, rules_among, spark_query
from ..plans.shared import spread, written

_CHEM = "SELECT document_id, product_name, cas, hazard_class, p_size FROM chem"
#: Body of each section of a made-up sheet, as parts that both engines join: text, or a column's name in brackets.
BODIES = {
    1: ["Product name: ", "[product_name]", " [", "[document_id]", "]\nManufacturer: Maker ", "[maker]", " LTDA"],
    2: ["Signal word DANGER\nStatements H225 + H319, P280\nGHS02, GHS07"],
    3: ["[product_name]", " ", "[cas]", " ", "[low]", "-", "[high]", "%\nWater 7732-18-5 30 – 40 %\nEthanol 64–17–S >= 99%"],
    9: ["Flash point: ", "[p_size]", ".5 °C\npH: 7.0"],
    10: ["Stable as supplied\nIncompatible with: strong acids, ", "[avoid]"],
    14: ["UN ", "[un]", "\nClasse de risco: ", "[hazard_class]", "\nGrupo de embalagem: ", "[packing]"],
}
TITLES = {1: "Identification of the substance", 2: "Hazards of the substance", 3: "Composition of the mixture", 9: "Properties", 10: "Stability and reactivity", 14: "Transport data"}
MADE = {
    "maker": "CAST(document_id % 25 AS STRING)", "low": "CAST(p_size % 40 AS STRING)", "high": "CAST(p_size % 40 + 10 AS STRING)", "avoid": "CASE WHEN p_size % 2 = 0 THEN 'water' ELSE 'oxidizers' END",
    "un": "CAST(1000 + document_id % 2500 AS STRING)", "packing": "CAST(p_size % 3 + 1 AS STRING)",
}


def _value(name: str) -> str:
    return MADE.get(name, f"CAST({name} AS STRING)")


def _concat(parts: list[str]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    made = [_value(p[1:-1]) if p[0] == "[" and p[-1] == "]" else " || chr(10) || ".join(quoted(x) for x in p.split("\n")) for p in parts]
    return "concat(" + ", ".join(made) + ")"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, text, sections, profile) of a sheet for each chemical."""
    whole = "SAFETY DATA SHEET", *(f"SECTION {n}: {TITLES[n]}" for n in BODIES)
    parts: list[str] = [whole[0] + "\n"]
    for n, head in zip(BODIES, whole[1:], strict=True):
        parts += [head + "\n", *BODIES[n], "\n\n"]
    rows = spread(spark_query(spark, sf_dir, _CHEM), "document_id").selectExpr("document_id", f"{_concat(parts)} AS text", "CASE WHEN document_id % 3 = 0 THEN 'maker' ELSE 'other' END AS profile")
    return rows.select("document_id", "text", sections(F.col("text")).alias("sections"), "profile")


def sections_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).select("document_id", F.explode("sections").alias("section", "body"))


SECTIONS_SQL = " UNION ALL ".join(f"SELECT document_id, {n} AS section, {_concat(BODIES[n])} AS body FROM ({_CHEM}) c" for n in BODIES)

_VALUES = {
    "product_name": "concat(product_name, ' [', CAST(document_id AS STRING), ']')", "manufacturer": f"concat('Maker ', {_value('maker')}, ' LTDA')", "cas_number": "cas", "un_number": _value("un"), "hazard_class": "hazard_class",
    "packing_group": "CASE p_size % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END", "h_statements": "'H225 + H319'", "p_statements": "'P280'", "incompatibilities": f"concat('strong acids, ', {_value('avoid')})",
    "ghs_pictograms": "'GHS02, GHS07'", "signal_word": "'DANGER'", "flash_point": "concat(CAST(p_size AS STRING), '.5 °C')", "ph": "'7.0'",
}
#: A maker's own patterns: the number at the end of the first line of section 1, and the whole match of a word.
OVERRIDES = {"maker": {"product_name": r"product name:.*\[(\d+)\]", "signal_word": "danger"}}


def _fields_sql(values: dict[str, str], sure: dict[str, str]) -> str:
    base = lambda f, v: sure.get(f) or f"round({BASE_CONFIDENCE.get(f, 0.70)}E0 - CASE WHEN length({v}) < 2 THEN 0.2E0 WHEN length({v}) > 200 THEN 0.1E0 ELSE 0 END, 6)"
    return " UNION ALL ".join(f"SELECT document_id, '{f}' AS field_name, {v} AS value, {base(f, v)} AS confidence FROM ({_CHEM}) c" for f, v in values.items())


def heuristic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_fields(sheets(spark, sf_dir).drop("profile"), context=False)
    return found.select("document_id", "field_name", "value", F.round("confidence", 6).alias("confidence"))


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_fields(sheets(spark, sf_dir), overrides=OVERRIDES, context=False)
    return found.select("document_id", "field_name", "value", F.round("confidence", 6).alias("confidence"), "source")


_OVER = "document_id % 3 = 0"
PROFILE_SQL = f"""SELECT document_id, field_name, CASE WHEN {_OVER} AND field_name = 'product_name' THEN CAST(document_id AS STRING) ELSE value END AS value,
    CASE WHEN {_OVER} AND field_name IN ('product_name', 'signal_word') THEN 0.95E0 ELSE confidence END AS confidence,
    CASE WHEN {_OVER} AND field_name IN ('product_name', 'signal_word') THEN 'heuristic_profile_maker' ELSE 'heuristic' END AS source FROM ({_fields_sql(_VALUES, {})}) f"""


def ingredient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingredients(sheets(spark, sf_dir))
    return found.select("document_id", "cas_number", "chemical_name", "concentration_min", "concentration_max", F.round("confidence", 6).alias("confidence"), "line_no")


INGREDIENTS_SQL = f"""SELECT document_id, cas AS cas_number, product_name AS chemical_name, CAST(p_size % 40 AS DOUBLE) AS concentration_min, CAST(p_size % 40 + 10 AS DOUBLE) AS concentration_max, 0.85E0 AS confidence, 1 AS line_no FROM ({_CHEM}) c
    UNION ALL SELECT document_id, '7732-18-5', 'Water', 30.0E0, 40.0E0, 0.85E0, 2 FROM ({_CHEM}) c UNION ALL SELECT document_id, '64-17-5', 'Ethanol', 99.0E0, CAST(NULL AS DOUBLE), 0.85E0, 3 FROM ({_CHEM}) c"""


# names, classes, codes

_NAME = "concat(CASE p_size % 5 WHEN 0 THEN '  ACME ' WHEN 1 THEN 'Brand ' ELSE '' END, product_name, CASE p_size % 4 WHEN 0 THEN ' > 99% pure' WHEN 1 THEN '  acid trade' ELSE '' END)"


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, f"SELECT document_id, CASE WHEN document_id % 50 = 0 THEN 'h2so4' ELSE {_NAME} END AS raw FROM chem")
    return rows.select("document_id", names.product_name(F.col("raw")).alias("name"))


NORMALIZE_SQL = """SELECT document_id, CASE WHEN document_id % 50 = 0 THEN 'Ácido Sulfúrico' WHEN p_size % 4 = 0 THEN concat(product_name, ' >') WHEN p_size % 4 = 1 THEN concat(product_name, ' acid') ELSE product_name END AS name FROM chem"""


def hazard_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """CASE p_size % 6 WHEN 0 THEN 'flam. liq' WHEN 1 THEN '["Skin Irrit. 2", "zzz q"]' WHEN 2 THEN '{"oxidizer": true, "toxic": false}' WHEN 3 THEN 'Acute Tox. 4 (oral)' WHEN 4 THEN 'blue-green kind' ELSE '' END"""
    rows = spark_query(spark, sf_dir, f"SELECT document_id, {raw} AS raw FROM chem")
    return rows.select("document_id", F.explode(names.hazard_names(F.col("raw"))).alias("name"))


HAZARD_SQL = """SELECT document_id, unnest(CASE p_size % 6 WHEN 0 THEN ['Flammable Liquid'] WHEN 1 THEN ['Skin Irritation', 'Zzz Q'] WHEN 2 THEN ['Oxidizer'] WHEN 3 THEN ['Acute Toxicity'] WHEN 4 THEN ['Blue-Green Kind'] ELSE [] END) AS name FROM chem"""


def _codes(field: str, letter: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark_query(spark, sf_dir, f"SELECT document_id, concat(value, ' {letter}510 {letter}099') AS value FROM extractions WHERE field_name = '{field}'")
        return rows.select("document_id", F.array_join(names.statement_codes(F.col("value"), letter), ",").alias("codes"))

    return run


def _codes_sql(field: str, letter: str, least: int, most: int) -> str:
    return f"""SELECT document_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(concat(value, ' {letter}510 {letter}099'), '{letter}[0-9][0-9][0-9]'), lambda x: CAST(x[2:4] AS INT) BETWEEN {least} AND {most}))), ',') AS codes
        FROM extractions WHERE field_name = '{field}'"""


def enricher_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """CASE p_size % 4 WHEN 0 THEN '["H225", "x", "H301 bad"]' WHEN 1 THEN '{"H300": "fatal", "note": ""}' WHEN 2 THEN '[H315, H319 x' ELSE 'H225, H319' END"""
    rows = spark_query(spark, sf_dir, f"SELECT document_id, {raw} AS raw FROM chem")
    return rows.select("document_id", F.array_join(names.listed_codes(F.col("raw"), "H"), ";").alias("codes"))


ENRICHER_SQL = "SELECT document_id, CASE p_size % 4 WHEN 0 THEN 'H225;H301 bad' WHEN 1 THEN 'H300;note' WHEN 2 THEN 'H319' ELSE '' END AS codes FROM chem"


def mol_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = "CASE p_size % 4 WHEN 0 THEN concat('C', CAST(p_size + 1 AS STRING), 'H', CAST(2 * p_size AS STRING), 'OCl') WHEN 1 THEN CAST(p_size * 7 AS STRING) WHEN 2 THEN 'xyz' ELSE concat('NaOH Zz', CAST(p_size AS STRING)) END"
    rows = spark_query(spark, sf_dir, f"SELECT document_id, {formula} AS formula FROM chem")
    return rows.select("document_id", names.molecular_weight(F.col("formula")).alias("weight"))


WEIGHT_SQL = """SELECT document_id, CASE p_size % 4 WHEN 0 THEN 12.0E0 * (p_size + 1) + CASE WHEN p_size = 0 THEN 0 ELSE 2 * p_size END + 51.5E0 WHEN 1 THEN p_size * 7.0E0 WHEN 2 THEN NULL ELSE 40.0E0 END AS weight FROM chem"""


def pictogram_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, concat('GHS0', CAST(p_size % 9 + 1 AS STRING), ', ghs99,') AS codes FROM chem")
    return rows.select("document_id", F.array_join(names.pictograms(F.col("codes")), "; ").alias("pictograms"))


PICTOGRAM_SQL = f"""SELECT document_id, concat(code, ' (', name, '); ghs99') AS pictograms FROM (SELECT document_id, concat('GHS0', CAST(p_size % 9 + 1 AS VARCHAR)) AS code FROM chem) c
    JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in names.PICTOGRAMS.items())}) AS t(code, name) USING (code)"""


def dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, CASE WHEN p_size % 3 = 0 THEN concat(hazard_class, '.', CAST(p_size % 7 AS STRING)) ELSE hazard_class END AS value FROM chem")
    return rows.select("document_id", "value", is_dangerous(F.col("value")).alias("dangerous"))


DANGEROUS_SQL = f"""SELECT document_id, value, value IN ({", ".join(f"'{c}'" for c in DANGEROUS)}) AS dangerous FROM (
    SELECT document_id, CASE WHEN p_size % 3 = 0 THEN concat(hazard_class, '.', CAST(p_size % 7 AS VARCHAR)) ELSE hazard_class END AS value FROM chem) c"""


def base_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, field_name, value FROM extractions")
    return rows.select("document_id", "field_name", F.round(base_confidence(F.col("field_name"), F.col("value")), 6).alias("confidence"))


BASE_SQL = f"""SELECT document_id, field_name, round(coalesce(base, 0.7E0) - CASE WHEN length(coalesce(value, '')) < 2 THEN 0.2E0 WHEN length(value) > 200 THEN 0.1E0 ELSE 0 END, 6) AS confidence
    FROM extractions LEFT JOIN (VALUES {", ".join(f"('{k}', {v}E0)" for k, v in BASE_CONFIDENCE.items())}) AS b(field_name, base) USING (field_name)"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    rows = spark_query(spark, sf_dir, """SELECT document_id, field_name, confidence, CASE document_id % 4 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'llm' WHEN 2 THEN 'rag' ELSE 'elsewhere' END AS source,
        CASE WHEN document_id % 5 = 0 THEN 0.15E0 ELSE 0.0E0 END AS boost, document_id % 2 = 0 AS crossed FROM extractions""")
    c = F.col
    return rows, names.field_score(c("field_name"), c("confidence"), c("source"), F.lit(0.95), c("boost"), c("crossed"), F.lit(names.PATTERN))


def score_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score = _scored(spark, sf_dir)
    return rows.select("document_id", "field_name", F.round(score, 8).alias("score"))


SCORE_SQL = """SELECT document_id, field_name, round(greatest(0.0E0, least(1.0E0, (s + m * (1 - s)) * 0.875E0)), 8) AS score FROM (SELECT document_id, field_name,
    confidence + 0.15E0 * CASE document_id % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.85E0 ELSE 0.7E0 END AS s, CASE WHEN document_id % 5 = 0 THEN 0.15E0 ELSE 0 END + CASE WHEN document_id % 2 = 0 THEN 0.08E0 ELSE 0 END AS m FROM extractions) x"""


def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, field_name, confidence + 0.001E0 AS confidence FROM extractions")
    return rows.select("document_id", "field_name", names.quality_tier(F.col("field_name"), F.col("confidence")).alias("tier"))


TIER_SQL = f"""SELECT document_id, field_name, CASE WHEN d >= 0.15E0 THEN 'excellent' WHEN d >= 0 THEN 'good' WHEN d >= -0.1E0 THEN 'acceptable' WHEN d >= -0.2E0 THEN 'poor' ELSE 'unreliable' END AS tier
    FROM (SELECT document_id, field_name, confidence + 0.001E0 - coalesce(t, 0.7E0) AS d FROM extractions LEFT JOIN (VALUES {", ".join(f"('{k}', {v}E0)" for k, v in names.THRESHOLDS.items())}) AS h(field_name, t) USING (field_name)) x"""


def file_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT id, concat(CASE id % 5 WHEN 0 THEN 'Guia_' WHEN 1 THEN 'Safety_Guide_' WHEN 2 THEN 'script_' WHEN 3 THEN 'Chart-' ELSE 'f' END, CAST(id AS STRING), '.pdf') AS name FROM sds_documents")
    return rows.select("id", names.file_language(F.col("name")).alias("lang"))


FILE_SQL = "SELECT id, CASE WHEN id % 5 IN (0, 2) THEN 'pt' ELSE 'en' END AS lang FROM sds_documents"


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after a line of terms in its language, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.when(F.col("lang") == "de", "HERSTELLER, Gefahr, stabilität\n").when(F.col("lang") == "fr", "DANGER, Fabricant, urgence\n").when(F.col("lang") == "es", "PELIGRO, Fabricante, emergencia\n").otherwise("Gefahr, urgence\n")
    return docs.select("doc_id", F.md5(names.translate_terms(F.concat(head, "text"), F.col("lang"))).alias("translated"))


def _translate_sql() -> str:
    def done(lang: str, text: str) -> str:
        for a, b in names.TERMS[lang].items():
            for x, y in ((a, b), (a.title(), b.title()), (a.upper(), b.upper())):
                text = f"replace({text}, '{x}', '{y}')"
        return text

    heads = {"de": "MANUFACTURER, Hazard, stability", "fr": "HAZARD, Manufacturer, emergency", "es": "HAZARD, Manufacturer, emergency"}
    cases = " ".join(f"WHEN '{k}' THEN concat('{v}', chr(10), {done(k, 'text')})" for k, v in heads.items())
    return f"SELECT doc_id, md5(CASE lang {cases} ELSE concat('Gefahr, urgence', chr(10), text) END) AS translated FROM documents"


def llm_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """CASE p_size % 6 WHEN 0 THEN '{"value": "a", "confidence": 0.9}' WHEN 1 THEN ' {"answer": "b", "method": "rag"} ' WHEN 2 THEN '{broken}' WHEN 3 THEN '{"text": "c", "confidence": 0.5}' WHEN 4 THEN product_name ELSE '["d", 1]' END"""
    rows = spark_query(spark, sf_dir, f"SELECT document_id, {raw} AS raw FROM chem")
    return rows.select("document_id", normal_answer(F.col("raw")).alias("a")).select("document_id", "a.value", "a.confidence", "a.method")


LLM_SQL = """SELECT document_id, CASE p_size % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '{broken}' WHEN 3 THEN 'c' WHEN 4 THEN product_name ELSE '["d", 1]' END AS value,
    CASE p_size % 6 WHEN 0 THEN 0.9E0 WHEN 3 THEN 0.5E0 ELSE 0.7E0 END AS confidence, CASE WHEN p_size % 6 = 1 THEN 'rag' ELSE 'llm' END AS method FROM chem"""


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").alias("n"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return chunks.chunk_documents(docs)


# the matrix and pairs

_PRODUCTS = "SELECT document_id, product_name, cas_number, incompatibilities, hazard_class, avg_confidence AS confidence, processed_at FROM wide"
#: Products of the matrix: the latest, as many as the reports show at once.
LATEST = 500


def incompat_matrix(spark: SparkSession, sf_dir: str, latest: int | None = LATEST) -> DataFrame:
    """The matrix of the ``latest`` products, or of all with None."""
    products = spark_query(spark, sf_dir, _PRODUCTS)
    if latest is not None:
        products = products.orderBy(F.desc_nulls_last("processed_at"), "document_id").limit(latest)
    rules = rules_among(spark, sf_dir, products.select(F.col("cas_number").alias("cas")))
    return matrix.compatibility_matrix(products, rules, spark_query(spark, sf_dir, "SELECT * FROM hazards")).drop("layer")


MATRIX_SQL = f"""WITH p AS (SELECT document_id, product_name, cas_number, incompatibilities FROM wide ORDER BY processed_at DESC NULLS LAST, document_id LIMIT {LATEST}),
    risk AS (SELECT DISTINCT cas FROM hazards WHERE env_risk OR idlh <= 50 OR json_extract_string(hazard_flags, '$.dangerous') = 'true')
    SELECT a.document_id AS id_a, b.document_id AS id_b, CASE WHEN a.product_name = b.product_name THEN 'Self' WHEN r.rule = 'I' THEN 'Incompatible' WHEN r.rule = 'R' THEN 'Restricted'
        WHEN len(list_filter(string_split(coalesce(a.incompatibilities, ''), ','), lambda t: trim(t) <> '' AND contains(lower(b.product_name), lower(trim(t))))) > 0 THEN 'Incompatible'
        WHEN x.cas IS NOT NULL OR y.cas IS NOT NULL THEN 'Restricted' ELSE 'Compatible' END AS decision
    FROM p a JOIN p b ON a.product_name IS NOT NULL AND b.product_name IS NOT NULL LEFT JOIN rules r ON r.cas_a = least(a.cas_number, b.cas_number) AND r.cas_b = greatest(a.cas_number, b.cas_number) AND a.cas_number IS NOT NULL AND b.cas_number IS NOT NULL
    LEFT JOIN risk x ON x.cas = a.cas_number LEFT JOIN risk y ON y.cas = b.cas_number"""


def check_pair(spark: SparkSession, sf_dir: str, first: str = "ring", second: str = "Strong bases") -> DataFrame:
    return matrix.check_pair(spark_query(spark, sf_dir, _PRODUCTS).withColumn("product_name", F.when(F.col("document_id") == 1, F.concat("product_name", F.lit(" strong bases"))).otherwise(F.col("product_name"))), first, second)


CHECK_SQL = """WITH p AS (SELECT document_id, CASE WHEN document_id = 1 THEN concat(product_name, ' strong bases') ELSE product_name END AS product_name, incompatibilities, hazard_class, avg_confidence FROM wide),
    a AS (SELECT * FROM p WHERE contains(lower(product_name), 'ring') ORDER BY document_id DESC LIMIT 1), b AS (SELECT * FROM p WHERE contains(lower(product_name), 'strong bases') ORDER BY document_id DESC LIMIT 1)
    SELECT coalesce(len(list_filter(string_split(coalesce(a.incompatibilities, ''), ','), lambda t: trim(t) <> '' AND contains('strong bases', lower(trim(t))))) = 0, TRUE) AS compatible,
        coalesce(CASE WHEN b.document_id IS NOT NULL THEN a.avg_confidence END, 0.0E0) AS confidence, CASE WHEN b.document_id IS NOT NULL THEN a.hazard_class END AS hazard_class_1, CASE WHEN a.document_id IS NOT NULL THEN b.hazard_class END AS hazard_class_2
    FROM (SELECT 1 AS one) o LEFT JOIN a ON TRUE LEFT JOIN b ON TRUE"""


def decision_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT cas_a, cas_b, rule, source, CASE WHEN cas_a LIKE '6%' THEN NULL ELSE cas_a END AS a FROM rules")
    return rows.select("cas_a", "cas_b", matrix.decision_hash(F.lit("one"), F.lit("two"), F.col("a"), F.col("cas_b"), F.col("rule"), F.lit("structured_rule"), F.nullif("source", F.lit("orders"))).alias("decision_hash"))


HASH_SQL = "SELECT cas_a, cas_b, sha256('one|two|' || CASE WHEN cas_a LIKE '6%' THEN 'None' ELSE cas_a END || '|' || cas_b || '|' || rule || '|structured_rule|') AS decision_hash FROM rules"


def calc_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, l_orderkey, line_no, concat(CASE line_no % 4 WHEN 0 THEN 'Acetone ' WHEN 1 THEN 'fuming sulfuric acid ' WHEN 2 THEN 'benzene ' ELSE '' END, chemical_name) AS chemical_name, concentration_max FROM ingredients")
    return matrix.calculated_hazards(rows).select("document_id", "l_orderkey", "line_no", "code", "category")


CALC_SQL = """SELECT document_id, l_orderkey, line_no, code, category FROM ingredients JOIN (VALUES (0, 'H225', '2', 50.0E0), (1, 'H314', '1A', 10.0E0), (1, 'H315', '2', 1.0E0), (2, 'H350', '1A', 0.1E0)) AS t(k, code, category, least_conc)
    ON line_no % 4 = k AND concentration_max >= least_conc"""


def hazard_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, h_statements, p_size FROM wide JOIN (SELECT document_id AS d, p_size FROM chem) c ON d = document_id")
    calculated = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("H300"), F.lit("H319"))).otherwise(F.array(F.lit("H319")))
    return rows.select("document_id", matrix_status(calculated, F.col("h_statements")).alias("x")).select("document_id", "x.status", F.array_join("x.missing", ",").alias("missing"))


def matrix_status(calculated: Column, declared: Column) -> Column:
    return names.consistency(calculated, names.statement_codes(F.coalesce(declared, F.lit("")), "H"))


CONSISTENCY_SQL = """SELECT document_id, CASE WHEN missing = '' THEN 'valid' ELSE 'inconsistent' END AS status, missing FROM (SELECT w.document_id, concat_ws(',', CASE WHEN p_size % 2 = 0 AND NOT contains(coalesce(h_statements, ''), 'H300') THEN 'H300' END,
    CASE WHEN NOT contains(coalesce(h_statements, ''), 'H319') THEN 'H319' END) AS missing FROM wide w JOIN chem c ON c.document_id = w.document_id) x"""


# graph

def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges both ways, over rules that are written once for the walks that read them several times, and the start, which is written too."""
    rules = written(spark_query(spark, sf_dir, "SELECT cas_a, cas_b, rule FROM rules"), "rules")
    start = spark_query(spark, sf_dir, "SELECT min(cas_a) AS start FROM rules WHERE rule = 'I'", rules).filter("start is not null")
    return spark_query(spark, sf_dir, "SELECT src, dst FROM both_ways", rules), written(start, "start")


def reaction_chains(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """How many chains of each length end at each chemical."""
    edges, starts = _edges(spark, sf_dir)
    paths = walks.simple_paths(edges, starts, depth)
    return paths.groupBy((F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("cas")).agg(F.count("*").alias("n"))


CHAINS_SQL = """WITH e AS (SELECT DISTINCT src, dst FROM both_ways), one AS (SELECT src AS a, dst AS b FROM e WHERE src = (SELECT min(cas_a) FROM rules WHERE rule = 'I')), two AS (SELECT a, b, dst AS c FROM one JOIN e ON src = b AND dst <> a),
    three AS (SELECT a, b, c, dst AS d FROM two JOIN e ON src = c AND dst <> a AND dst <> b)
    SELECT 1 AS depth, b AS cas, count(*) AS n FROM one GROUP BY b UNION ALL SELECT 2, c, count(*) FROM two GROUP BY c UNION ALL SELECT 3, d, count(*) FROM three GROUP BY d"""


def bfs_incompat(spark: SparkSession, sf_dir: str, depth: int = 2) -> DataFrame:
    edges, starts = _edges(spark, sf_dir)
    return walks.nearest(edges, starts, depth).select(F.col("node").alias("cas"), "depth")


BFS_SQL = """WITH s AS (SELECT min(cas_a) AS cas FROM rules WHERE rule = 'I'), one AS (SELECT DISTINCT dst AS cas FROM both_ways JOIN s ON src = cas), two AS (SELECT DISTINCT dst AS cas FROM both_ways JOIN one ON src = cas)
    SELECT cas, 1 AS depth FROM one WHERE cas NOT IN (SELECT cas FROM s) UNION ALL SELECT cas, 2 FROM two WHERE cas NOT IN (SELECT cas FROM one) AND cas NOT IN (SELECT cas FROM s)"""


def k_hop(spark: SparkSession, sf_dir: str, depth: int = 1) -> DataFrame:
    edges, starts = _edges(spark, sf_dir)
    return walks.neighbourhood(edges, starts, depth).select("src", "dst")


HOP_SQL = """WITH s AS (SELECT min(cas_a) AS cas FROM rules WHERE rule = 'I'), n AS (SELECT cas FROM s UNION SELECT dst FROM both_ways JOIN s ON src = cas)
    SELECT DISTINCT src, dst FROM both_ways WHERE src IN (SELECT cas FROM n) AND dst IN (SELECT cas FROM n)"""

_PRINT = "[p_size % 10, 100 + p_size % 4, 200 + length(p_brand), 300 + length(product_name), 400 + document_id % 3, 500 + document_id % 11, 600 + document_id % 2]"


def tanimoto(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    rows = spark_query(spark, sf_dir, f"SELECT document_id AS id, array({_PRINT[1:-1]}) AS bits FROM chem")
    rows = rows.withColumn("bits", F.transform("bits", lambda x: x.cast("int")))
    return walks.tanimoto_pairs(rows, threshold).withColumn("similarity", F.round("similarity", 6))


TANIMOTO_SQL = f"""WITH f AS (SELECT document_id AS id, list_distinct({_PRINT}) AS bits FROM chem)
    SELECT a.id AS a, b.id AS b, round(CAST(len(list_intersect(a.bits, b.bits)) AS DOUBLE) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))), 6) AS similarity FROM f a JOIN f b ON a.id < b.id
    WHERE len(list_intersect(a.bits, b.bits)) >= 0.7 * (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)))"""

#: Stored similarities: chemicals of one hazard profile, by how many flags it has.
_PROFILED = "SELECT cas, concat(CAST(flammable AS STRING), CAST(toxic AS STRING), CAST(corrosive AS STRING)) AS profile, CAST(flammable AS INT) + CAST(toxic AS INT) + CAST(corrosive AS INT) AS n FROM hazards"


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cas, score, partners): a chemical's stored similarity with each of its partners, the others of its profile."""
    rows = spark_query(spark, sf_dir, _PROFILED).filter("n > 0")
    held = rows.groupBy("profile").agg(F.count("*").alias("m")).filter("m > 1")
    return rows.join(held, "profile").select("cas", F.least(F.lit(0.95), 0.7 + 0.05 * F.col("n")).alias("score"), (F.col("m") - 1).alias("partners"))


def similarity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by score in steps of 0.1; a pair is counted once."""
    return _similar(spark, sf_dir).groupBy(F.round("score", 1).alias("bucket")).agg((F.sum("partners") / 2).cast("long").alias("n"))


def similarity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).filter("score >= 0.7").select("cas", F.col("partners").alias("degree"))


_SIMILAR_SQL = f"WITH p AS ({_PROFILED}), pairs AS (SELECT a.cas AS x, b.cas AS y, least(0.95E0, 0.7E0 + 0.05E0 * a.n) AS score FROM p a JOIN p b ON a.profile = b.profile AND a.cas < b.cas WHERE a.n > 0)"


def hybrid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stated questions over the rules and the documents' vectors."""
    edges, starts = _edges(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.filter("vec_id in (0, 100, 200)").crossJoin(F.broadcast(starts)).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") < 200, F.concat(F.lit("What reacts with "), "start", F.lit("?"))).otherwise("Is water safe?").alias("question"), "embedding")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.concat(F.col("doc_id").cast("string"), F.lit(": "), "text").alias("content"))
    return walks.hybrid_contexts(asked, edges, e.join(texts, "vec_id").select("content", "embedding"))


def doc_components(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Communities of the vectors and the stated ones (ids divisible by 100), joined where their similarity is over ``least``."""
    from .vector import doc_similarity

    near = written(doc_similarity(spark, sf_dir, least), "near")  # both directions read it
    return walks.communities(near.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("score").alias("weight")))


def enrichment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outside source does to a value: adds a missing one, raises an equal one, or warns of another."""
    rows = spark_query(spark, sf_dir, "SELECT document_id, value, confidence, cas FROM (SELECT document_id, value, confidence FROM extractions WHERE field_name = 'cas_number') e JOIN (SELECT document_id AS d, CASE WHEN p_size % 6 = 0 THEN '64-17-5' ELSE cas END AS cas FROM chem) c ON d = document_id")
    lacking = F.coalesce(F.col("value"), F.lit("")).isin("", "NOT_FOUND", "N/A")
    return rows.select(
        "document_id", F.when(lacking, F.col("cas")).otherwise(F.col("value")).alias("value"),
        F.round(F.when(lacking, 0.85).when(F.col("value") == F.col("cas"), F.least(F.lit(0.95), F.col("confidence") + 0.1)).otherwise(F.col("confidence")), 6).alias("confidence"),
        F.when(lacking, "added").when(F.col("value") == F.col("cas"), "confirmed").otherwise("warning").alias("outcome"),
    )


APPLY_SQL = """SELECT e.document_id, CASE WHEN bad THEN known ELSE value END AS value, round(CASE WHEN bad THEN 0.85E0 WHEN value = known THEN least(0.95E0, confidence + 0.1E0) ELSE confidence END, 6) AS confidence,
    CASE WHEN bad THEN 'added' WHEN value = known THEN 'confirmed' ELSE 'warning' END AS outcome FROM (SELECT document_id, value, confidence, coalesce(value, '') IN ('', 'NOT_FOUND', 'N/A') AS bad FROM extractions WHERE field_name = 'cas_number') e
    JOIN (SELECT document_id, CASE WHEN p_size % 6 = 0 THEN '64-17-5' ELSE cas END AS known FROM chem) c ON c.document_id = e.document_id"""


# tables

def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, field_name, value, confidence FROM extractions")
    return rows.select("document_id", "field_name", tables.validate(F.col("field_name"), F.col("value"), F.col("confidence")).alias("status"))


VALIDATION_SQL = """SELECT document_id, field_name, CASE WHEN value IS NULL OR value IN ('', 'NOT_FOUND', 'ERROR') OR confidence < 0.7 THEN 'invalid' WHEN confidence < 0.9 THEN 'warning'
    WHEN field_name = 'cas_number' AND NOT regexp_full_match(value, '[0-9]{2,7}-[0-9]{2}-[0-9]') THEN 'warning' ELSE 'valid' END AS status FROM extractions"""


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' answers to one question for each five calls."""
    rows = spark_query(spark, sf_dir, "SELECT id, id - id % 5 AS question, model, CASE WHEN success THEN concat('v', CAST(id % 2 * (id % 3) AS STRING)) ELSE 'NOT_FOUND' END AS value, confidence FROM llm_calls")
    rows = rows.withColumn("model", F.concat("model", F.lit(" "), F.lpad(F.col("id").cast("string"), 12, "0")))
    return tables.consensus(rows, ["question"]).withColumn("confidence", F.round("confidence", 6))


CONSENSUS_SQL = """WITH a AS (SELECT id - id % 5 AS question, concat(model, ' ', lpad(CAST(id AS VARCHAR), 12, '0')) AS model, CASE WHEN success THEN concat('v', CAST(id % 2 * (id % 3) AS VARCHAR)) END AS value, confidence FROM llm_calls),
    g AS (SELECT question, count(value) AS n, count(DISTINCT value) AS k, avg(confidence) FILTER (WHERE value IS NOT NULL) AS mean FROM a GROUP BY question),
    b AS (SELECT question, value, confidence FROM a WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question ORDER BY confidence DESC, model) = 1)
    SELECT g.question, coalesce(b.value, 'NOT_FOUND') AS value, round(CASE WHEN k = 1 AND n > 1 THEN least(1.0E0, mean + 0.15E0) ELSE coalesce(b.confidence * 0.95E0, 0) END, 6) AS confidence,
        CASE WHEN k = 1 AND n > 1 THEN 'consensus' WHEN n > 0 THEN 'best-effort' END AS source FROM g LEFT JOIN b ON b.question = g.question"""


def rule_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as they come in: the other way round, with blanks, in small letters; a second lot of some of them follows."""
    rows = spark_query(spark, sf_dir, "SELECT concat(' ', cas_b) AS cas_a, cas_a AS cas_b, concat(lower(rule), ' ') AS rule, 1 AS seq FROM rules UNION ALL SELECT cas_a, cas_b, 'c', 2 FROM rules WHERE cas_a LIKE '6%'")
    return tables.normal_rules(rows, "seq")


RULES_SQL = "SELECT cas_a, cas_b, CASE WHEN cas_a LIKE '6%' THEN 'C' ELSE rule END AS rule FROM rules"


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_query(spark, sf_dir, "SELECT id, content_hash FROM rag_documents")
    return tables.insert_ignore(docs.filter("id % 2 = 0").groupBy("content_hash").agg(F.min("id").alias("id")), docs, ["content_hash"], ["id"])


IGNORE_SQL = "SELECT content_hash, coalesce(min(CASE WHEN id % 2 = 0 THEN id END), min(id)) AS id FROM rag_documents GROUP BY content_hash"


def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_query(spark, sf_dir, "SELECT document_id, cas_number, line_no FROM ingredients")
    return tables.replace_children(rows, rows.filter("document_id % 50 = 0").select("document_id", "cas_number", F.lit(1).alias("line_no")).distinct(), "document_id")


CHILDREN_SQL = "SELECT document_id, cas_number, line_no FROM ingredients WHERE document_id % 50 <> 0 UNION ALL SELECT DISTINCT document_id, cas_number, 1 FROM ingredients WHERE document_id % 50 = 0"
ALIASES = {"algeria": "widget", "Brazil".lower(): "no such", "peru": "bolt"}


def name_to_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' names and three kinds of products as names that are asked for."""
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("Ring ",), ("rod",), ("small gear",)], "name string"))
    return tables.match_names(asked, spark_query(spark, sf_dir, "SELECT cas, product_name FROM chem"), ALIASES)


NAMES_SQL = """WITH asked AS (SELECT n_name AS name FROM nation UNION ALL VALUES ('Ring '), ('rod'), ('small gear')), keyed AS (SELECT DISTINCT name, CASE lower(trim(name)) WHEN 'algeria' THEN 'widget' WHEN 'brazil' THEN 'no such' WHEN 'peru' THEN 'bolt' END AS alias, lower(trim(name)) AS own FROM asked)
    SELECT name, coalesce((SELECT min(cas) FROM chem WHERE contains(product_name, alias)), CASE WHEN length(own) > 3 THEN (SELECT min(cas) FROM chem WHERE contains(product_name, own)) END) AS cas FROM keyed"""


QUERIES = {
    "sections": sections_query, "heuristic_fields": heuristic_fields, "profile_fields": profile_fields, "ingredient_lines": ingredient_lines, "normalize_name": normalize_name, "hazard_normalize": hazard_normalize,
    "h_codes": _codes("h_statements", "H"), "p_codes": _codes("p_statements", "P"), "enricher_codes": enricher_codes, "mol_weight": mol_weight, "pictograms": pictogram_names, "is_dangerous": dangerous,
    "base_confidence": base_confidences, "score_field": score_field, "quality_tier": quality_tiers, "file_lang": file_lang, "translate_terms": translated, "llm_normalize": llm_normalize, "content_hash": content_hash,
    "chunk_recursive": chunk_recursive, "incompat_matrix": incompat_matrix, "check_pair": check_pair, "decision_hash": decision_hash, "calc_hazards": calc_hazards, "hazard_consistency": hazard_consistency,
    "reaction_chains": reaction_chains, "bfs_incompat": bfs_incompat, "k_hop": k_hop, "tanimoto_pairs": tanimoto, "similarity_hist": similarity_hist, "similarity_degree": similarity_degree,
    "hybrid_query": hybrid_query, "doc_components": doc_components, "enrichment_apply": enrichment_apply, "validation_status": validation_status, "consensus": consensus, "rule_normalize": rule_normalize,
    "insert_ignore": insert_ignore, "replace_children": replace_children, "name_to_cas": name_to_cas,
}
#: Chunks, hybrid contexts and communities have no SQL: they are tested against plain Python.
SQL = {k: duckdb_query(v) for k, v in {
    "sections": SECTIONS_SQL, "heuristic_fields": _fields_sql(_VALUES, {}), "profile_fields": PROFILE_SQL, "ingredient_lines": INGREDIENTS_SQL, "normalize_name": NORMALIZE_SQL, "hazard_normalize": HAZARD_SQL,
    "h_codes": _codes_sql("h_statements", "H", 200, 413), "p_codes": _codes_sql("p_statements", "P", 100, 510), "enricher_codes": ENRICHER_SQL, "mol_weight": WEIGHT_SQL, "pictograms": PICTOGRAM_SQL, "is_dangerous": DANGEROUS_SQL,
    "base_confidence": BASE_SQL, "score_field": SCORE_SQL, "quality_tier": TIER_SQL, "file_lang": FILE_SQL, "translate_terms": _translate_sql(), "llm_normalize": LLM_SQL,
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents", "incompat_matrix": MATRIX_SQL, "check_pair": CHECK_SQL, "decision_hash": HASH_SQL, "calc_hazards": CALC_SQL,
    "hazard_consistency": CONSISTENCY_SQL, "reaction_chains": CHAINS_SQL, "k_hop": HOP_SQL, "tanimoto_pairs": TANIMOTO_SQL, "similarity_hist": _SIMILAR_SQL + " SELECT round(score, 1) AS bucket, count(*) AS n FROM pairs GROUP BY 1",
    "similarity_degree": _SIMILAR_SQL + " SELECT cas, count(*) AS degree FROM (SELECT x AS cas FROM pairs UNION ALL SELECT y FROM pairs) u GROUP BY cas", "enrichment_apply": APPLY_SQL, "bfs_incompat": BFS_SQL,
    "validation_status": VALIDATION_SQL, "consensus": CONSENSUS_SQL, "rule_normalize": RULES_SQL, "insert_ignore": IGNORE_SQL, "replace_children": CHILDREN_SQL, "name_to_cas": NAMES_SQL,
}.items()}
