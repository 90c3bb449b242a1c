"""Queries over scraped pages, profiles, skipped files, taken texts and communities, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import communities, intake, profiles
from ..plans.domain import duckdb_query, spark_query
from ..plans.shared import spread, written
from ..sources import pages

_WORD = "CASE document_id % 4 WHEN 0 THEN 'flammable' WHEN 1 THEN 'TOXIC' WHEN 2 THEN 'Corrosive' ELSE 'inert' END"
#: A page made of the columns of a chemical: tags that aren't closed, nested blocks, four paragraphs of which three count, a script, entities.
_HTML = f"""concat('<html><head><title>T</title><script>var x = "Oxidizer 1-1-1";</script></head><body><h1>', product_name, ' &amp; co</h1>', chr(10), 'Synonyms: x, alpha-', CAST(document_id AS STRING), '; ', p_brand, chr(10),
    '<div><h3>Fire <b>Hazard</b></h3><p>It is ', {_WORD}, ' in air.<p>Second paragraph ', CAST(p_size AS STRING), '<p>short<p>Third one of them<p>Fourth one of them</div><h2>Health Effects</h2>',
    CASE WHEN document_id % 3 = 0 THEN '<p>tiny</p>' ELSE '<div>Wear <i>gloves</i> always</div>' END, '<h2>Other</h2><p>CAS ', cas, '</p><p>Health: ', CAST(p_size % 5 AS STRING), ' Flammability = ', CAST(document_id % 5 AS STRING), '</p></body></html>')"""


def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark_query(spark, sf_dir, "SELECT document_id, product_name, p_brand, p_size, cas FROM chem"), "document_id").selectExpr("document_id", f"{_HTML} AS html")
    got = pages.page_facts(rows, "document_id")
    rating = lambda n: F.try_element_at("nfpa", F.lit(n)).alias(n)
    return got.select("document_id", "name", "cas", F.array_join("synonyms", "|").alias("synonyms"), "fire_hazard", "health_hazard", F.array_join("hazards", ",").alias("hazards"), rating("health"), rating("flammability"))


PAGES_SQL = f"""SELECT document_id, concat(product_name, ' & co') AS name, cas, concat('alpha-', CAST(document_id AS STRING), '|', p_brand) AS synonyms,
    concat('It is ', {_WORD}, ' in air.', chr(10), 'Second paragraph ', CAST(p_size AS STRING), chr(10), 'Third one of them') AS fire_hazard, CASE WHEN document_id % 3 = 0 THEN '' ELSE 'Weargloves' || 'always' END AS health_hazard,
    CASE document_id % 4 WHEN 0 THEN 'Flammable' WHEN 1 THEN 'Toxic' WHEN 2 THEN 'Corrosive' ELSE '' END AS hazards, CAST(p_size % 5 AS INT) AS health, CAST(document_id % 5 AS INT) AS flammability FROM chem"""

PATTERNS = {"number": r"[0-9]+", "opening": r"^([A-Z][a-z]+)", "mark": r"[!?]+", "line": r"^.{200,}$"}


def profile_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of four patterns on the documents as samples."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file"), "text")
    return profiles.validate_profile(docs, PATTERNS).withColumns({"rate": F.round("rate", 6), "avg_confidence": F.round("avg_confidence", 6)})


_TRIED = " UNION ALL ".join(f"SELECT '{n}' AS field_name, CASE WHEN regexp_matches(text, '(?sm){p}') THEN trim(regexp_extract(text, '(?sm){p}', {1 if '(' in p else 0}), ' ' || chr(10) || chr(13) || chr(9)) END AS value FROM documents" for n, p in PATTERNS.items())
PROFILE_SQL = rf"""SELECT field_name, n, successes, round(successes / n, 6) AS rate, round(coalesce(sure, 0), 6) AS avg_confidence, CASE WHEN successes / n >= 0.9 THEN 'good' WHEN successes / n >= 0.7 THEN 'fair' ELSE 'poor' END AS status FROM (
    SELECT field_name, count(*) AS n, count(value) AS successes, avg(CASE WHEN length(value) < 3 THEN 0.5E0 ELSE 1 END * CASE WHEN regexp_matches(value, '[\p{{L}}\p{{N}}]') THEN 1 ELSE 0.3E0 END * CASE WHEN length(value) > 200 THEN 0.7E0 ELSE 1 END) FILTER (WHERE value IS NOT NULL) AS sure
    FROM ({_TRIED}) t GROUP BY field_name) x"""


def skip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are the sheets once more, some moved, some changed, some new, against the sheets with their extractions."""
    files = spark_query(spark, sf_dir, """SELECT concat(file_path, CASE id % 4 WHEN 0 THEN '.new' ELSE '' END) AS path, CASE WHEN id % 3 = 0 THEN concat('x', filename) ELSE filename END AS name,
        file_size_bytes AS size, CASE WHEN id % 5 = 0 THEN concat(file_hash, '!') ELSE file_hash END AS hash FROM sds_documents""")
    known = spark_query(spark, sf_dir, "SELECT id, file_path AS path, filename AS name, file_size_bytes + id % 2 AS size, file_hash AS hash, status, CASE WHEN id % 7 = 0 THEN 0 ELSE 9 END AS n_extractions FROM sds_documents")
    return intake.skip_reasons(files, known).select("path", "skip_reason", "document_id")


SKIP_SQL = """WITH f AS (SELECT concat(file_path, CASE id % 4 WHEN 0 THEN '.new' ELSE '' END) AS path, CASE WHEN id % 3 = 0 THEN concat('x', filename) ELSE filename END AS name, file_size_bytes AS size,
    CASE WHEN id % 5 = 0 THEN concat(file_hash, '!') ELSE file_hash END AS hash FROM sds_documents), k AS (SELECT id, file_path, filename, file_size_bytes + id % 2 AS size, file_hash, status FROM sds_documents WHERE id % 7 <> 0),
    n AS (SELECT f.path, (SELECT min(id) FROM k WHERE k.filename = f.name AND k.size = f.size) AS a, (SELECT min(id) FROM k WHERE k.file_path = f.path AND status IN ('completed', 'success')) AS b,
    (SELECT min(id) FROM k WHERE k.file_hash = f.hash) AS c, (SELECT min(g.path) FROM f g WHERE g.hash = f.hash) AS d FROM f)
    SELECT path, CASE WHEN a IS NOT NULL THEN 'same_name_and_size' WHEN b IS NOT NULL THEN 'same_path' WHEN c IS NOT NULL THEN 'same_hash' WHEN path > d THEN 'same_batch' END AS skip_reason, coalesce(a, b, c) AS document_id FROM n"""


def text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all documents as texts to take, where the hashes of every third are registered already; with the chunks of what is taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").cast("string").alias("title"), "text", "doc_id")
    registered = docs.filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("content_hash"))
    documents, _, outcomes = intake.take_texts(docs, registered)
    return outcomes.join(documents, ["content_hash", "source", "title"], "left").select("title", "outcome", F.col("chunk_count").isNotNull().alias("chunked"))


INTAKE_SQL = """WITH d AS (SELECT source, CAST(doc_id AS VARCHAR) AS title, text, doc_id, length(trim(coalesce(text, ''), ' ' || chr(10) || chr(13) || chr(9))) < 40 AS short FROM documents)
    SELECT title, outcome, outcome = 'taken' AS chunked FROM (SELECT title, CASE WHEN short THEN 'too_short' WHEN text IN (SELECT text FROM d WHERE doc_id % 3 = 0) OR row_number() OVER (PARTITION BY text ORDER BY source, title) > 1 THEN 'duplicate' ELSE 'taken' END AS outcome FROM d) x"""


def similar_communities(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Communities by modularity of the vectors and the stated ones (ids divisible by 100), joined where their similarity is over ``least``, with the modularity of all."""
    from .vector import doc_similarity

    near = written(doc_similarity(spark, sf_dir, least).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.col("score").alias("weight")), "near")  # both directions read it
    labels, q = communities.by_modularity(near)
    return labels.withColumn("modularity", F.lit(round(q, 6)))


def register_new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each file; the text in ``relational`` is the oracle, which compares all documents with one hash."""
    return intake.first_of_equal(spark_query(spark, sf_dir, "SELECT id, file_hash FROM sds_documents"))


QUERIES = {"register_new_docs": register_new_docs, "scraped_pages": scraped_pages, "profile_validation": profile_validation, "skip_plan": skip_plan, "text_intake": text_intake, "similar_communities": similar_communities}
SQL = {"scraped_pages": duckdb_query(PAGES_SQL), "profile_validation": PROFILE_SQL, "skip_plan": duckdb_query(SKIP_SQL), "text_intake": INTAKE_SQL}
